"""The registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jscompat, text, urls
from ..functions.rules import ALLERGEN_RULES, SITES
from ..operators import cache, classify, html, ingredients, recipe, refresh, search, sinks, sites, steps
from ..sources import responses
from ..sources.shared import each_text, shared_folder, stash
from . import synthetic as syn

FLAGSHIP = "normalize_recipe"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

def query(sql: str | None = None):
    """Register a query under its function's name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = syn.duck(sql)
        return f

    return add

def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

_WORDS = "list_filter(string_split(trim(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(text, 'ß', ' '), 'œ', 'oe'), 'Œ', 'oe'), 'æ', 'ae'), 'Æ', 'ae'))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"

@query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def text_tokenize(spark, sf_dir):
    t = text.tokenize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))

@query("SELECT p_partkey, lower(strip_accents(p_name)) || 'e' || 'oe' AS folded FROM part")
def text_ascii_lower(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.ascii_lower(F.concat("p_name", F.lit("ÉŒ"))).alias("folded"))

@query(f"SELECT recipe_id, pos, v IN (2) AS milk, v IN (3) AS eggs FROM ({syn.LINES})")
def keyword_match(spark, sf_dir):
    found = {"milk": text.matches_keywords(F.col("line"), ["lait"]), "eggs": text.matches_keywords(F.col("line"), ["oeuf"])}
    return each_text(syn.lines(spark, sf_dir), "line", found).select("recipe_id", "pos", "milk", "eggs")

@query(f"SELECT recipe_id, pos, v = 7 AS chickpeas, v = 17 AS film FROM ({syn.LINES})")
def phrase_match(spark, sf_dir):
    found = {"chickpeas": text.matches_keywords(F.col("line"), ["pois chiche"]), "film": text.matches_keywords(F.col("line"), ["film alimentaire"])}
    return each_text(syn.lines(spark, sf_dir), "line", found).select("recipe_id", "pos", "chickpeas", "film")

@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html.html_title(F.col("html")).alias("title"))

@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(jscompat.collapse_ws(text.strip_tags(F.col("html")))).alias("digest"))

@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def collapse_ws(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(jscompat.collapse_ws(F.col("text"))).cast("long").alias("n"))

@query("SELECT p_partkey, p_name || ' <&> é &amp' AS decoded FROM part")
def decode_entities(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.decode_entities(F.concat("p_name", F.lit(" &LT;&amp;&#x3E; &#233; &amp;amp"))).alias("decoded"))

@query("SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name FROM part")
def capitalize_first(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.capitalize_first(F.col("p_name")).alias("name"))

_URL = "regexp_replace(url, '#.*$', '')"

@query(f"SELECT page_id, CASE WHEN regexp_matches({_URL}, '^https?://[^/]*$') THEN {_URL} || '/' ELSE {_URL} END AS url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages")
def url_normalize(spark, sf_dir):
    u = urls.normalize_url(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", u["url"].alias("url"), u["host"].alias("host"))

_LETTERS = r"regexp_extract_all(text, '[a-zA-Z\p{L}]*[^\x00-\x7F\P{L}][a-zA-Z\p{L}]*')"

@query(f"SELECT lower(w) || '.example' AS shown, count(*) AS n, count(DISTINCT w) AS spellings FROM (SELECT unnest({_LETTERS}) AS w FROM documents) GROUP BY 1")
def url_host_scripts(spark, sf_dir):
    """Words with letters beyond ASCII as host names: plain, in capitals or percent-encoded, all of
    them must come to one ASCII form, and that form back to the word."""
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([a-zA-Z\p{L}]*[^\x00-\x7F\P{L}][a-zA-Z\p{L}]*)"), 1)).alias("w"))
    each = words.groupBy("w").agg(F.count("*").alias("n"))
    k = F.pmod(F.xxhash64("w"), F.lit(3))
    spelled = F.when((k == 0) & (F.length(F.upper("w")) == F.length("w")) & ~F.col("w").rlike("[\u03c2\u0131\u017f]"), F.upper("w")).when(k == 1, F.url_encode("w")).otherwise(F.col("w"))
    host = urls.normalize_url(F.concat(F.lit("https://"), spelled, F.lit("\uff0eExample/")))["host"]
    hosts = each.select("n", host.alias("host")).groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
    return hosts.select(urls.shown_host(F.col("host")).alias("shown"), "n", "spellings")

@query("SELECT o_orderkey, 'https://www.example.com/a/' || CAST(o_orderkey AS STRING) || '?q=1' AS url, 'www.example.com' AS host FROM orders")
def url_host(spark, sf_dir):
    """Unusual spellings, all of which the Python way must take to one form."""
    k = F.col("o_orderkey").cast("string")
    spelled = F.when(k % 2 == 0, F.concat(F.lit(" HTTPS://WWW.Example.com:443/x/../a/./"), k, F.lit("?q=1#f"))).otherwise(F.concat(F.lit("www.EXAMPLE.com/%2e/a/"), k, F.lit("?q=1")))
    u = urls.normalize_url(spelled)
    return _table(spark, sf_dir, "orders").select("o_orderkey", u["url"].alias("url"), u["host"].alias("host"))

@query("SELECT o_orderkey, 'https://www.example.com/b/' || CAST(o_orderkey AS STRING) AS url FROM orders")
def resolve_url(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return _table(spark, sf_dir, "orders").select("o_orderkey", urls.resolve_url(F.concat(F.lit("../b/"), k, F.lit("#x")), F.lit("https://www.example.com/a/c")).alias("url"))

_PATH = f"regexp_extract({_URL}, '^https?://[^/]*([^?]*)', 1)"
_LAST = f"list_last(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"
_NICE = f"trim(regexp_replace(regexp_replace({_LAST}, '\\.[^.]+$', ''), '[-_]+', ' ', 'g'))"

@query(f"SELECT page_id, coalesce(nullif(upper({_NICE}[1]) || {_NICE}[2:], ''), regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS name FROM pages")
def url_fallback_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.fallback_name(urls.normalize_url(F.col("url"))["url"]).alias("name"))

@query(f"SELECT id, source_name, source_license FROM ({syn.RECIPES})")
def source_meta(spark, sf_dir):
    r = syn.sql(spark, sf_dir, syn.RECIPES)
    m = sites.source_meta(urls.normalize_url(F.col("source_url"))["host"])
    return r.select("id", m["source_name"].alias("source_name"), m["source_license"].alias("source_license"))

@query(f"SELECT id, CASE WHEN canonical AND s < 6 THEN {syn._case('s', [syn._text(x[0]) for x in SITES])} END AS site_id FROM ({syn.RECIPES})")
def site_by_host(spark, sf_dir):
    r = syn.sql(spark, sf_dir, syn.RECIPES)
    return r.select("id", sites.site_of(F.upper(urls.normalize_url(F.col("source_url"))["host"])).alias("site_id"))

@query(f"SELECT query_id, site_rank, pos, own AS allowed FROM ({syn.hits_sql(False)})")
def host_allowed(spark, sf_dir):
    h = syn.sql(spark, sf_dir, syn.hits_sql(True)).withColumn("u", F.explode(F.array(urls.normalize_url(F.col("url")))))
    suffix = F.coalesce(*[F.when(F.col("site_rank") == i, F.lit(x[2])) for i, x in enumerate(SITES)])
    return h.select("query_id", "site_rank", "pos", urls.host_allowed(F.col("u.host"), F.array(suffix)).alias("allowed"))

@query("SELECT site_rank, site_id, source_name, host, count(r.id) AS n_recipes FROM (VALUES " + ", ".join(f"({i}, '{s}', '{n}', '{h}')" for i, (s, n, h, _, _) in enumerate(SITES)) + f") t(site_rank, site_id, source_name, host) LEFT JOIN (SELECT id, s FROM ({syn.RECIPES}) WHERE canonical) r ON r.s = site_rank GROUP BY ALL")
def site_list(spark, sf_dir):
    """The sites in their order, and how many of the recipes are theirs by their URLs' hosts."""
    found = syn.sql(spark, sf_dir, f"SELECT source_url FROM ({syn.RECIPES})").groupBy(sites.site_of(F.regexp_extract("source_url", "^https://([^/]+)", 1)).alias("site_id")).agg(F.count("*").alias("n"))
    listed = sites.sites(spark).join(found, "site_id", "left")
    return listed.select("site_rank", "site_id", "source_name", F.col("host_suffixes")[0].alias("host"), F.coalesce("n", F.lit(0).cast("long")).alias("n_recipes"))

@query("SELECT p_partkey, site_id, url || replace(prefix || p_name, ' ', '%20') || '%20!''()*~%C3%A9' AS search_url FROM part, (VALUES " + ", ".join(f"('{s}', '{u}', '{p.replace(':', '%3A')}')" for s, _, _, u, p in SITES) + ") t(site_id, url, prefix)")
def build_search_url(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(*[F.lit(x[0]) for x in SITES])).alias("site_id"))
    return p.select("p_partkey", "site_id", sites.build_search_url(F.col("site_id"), F.concat("p_name", F.lit(" !'()*~é"))).alias("search_url"))

# ingredient lines

@query(f"SELECT recipe_id, pos, name, quantity, unit FROM ({syn.LINES})")
def ing_full(spark, sf_dir):
    x = each_text(syn.lines(spark, sf_dir), "line", {"i": ingredients.parse_ingredient(F.col("line"))})
    return x.select("recipe_id", "pos", "i.name", "i.quantity", "i.unit")

@query(f"SELECT recipe_id, pos, CASE WHEN t = 2 THEN quantity / 10 WHEN t = 15 THEN NULL ELSE quantity END AS q FROM ({syn.LINES})")
def ing_quantity(spark, sf_dir):
    s = ingredients.ing_fractions(F.regexp_replace("line", "^- ", ""))
    return each_text(syn.lines(spark, sf_dir), "line", {"q": ingredients.ing_quantity(s)["q"]}).select("recipe_id", "pos", "q")

@query(f"SELECT recipe_id, pos, nullif(unit, 'unit') AS unit, CAST(CASE WHEN t = 2 THEN 10 WHEN unit <> 'unit' THEN 1 END AS INT) AS factor FROM ({syn.LINES})")
def ing_unit(spark, sf_dir):
    """Every line, behind its quantity of any form; null where no unit is given."""
    behind = lambda s: jscompat.js_trim(F.substring(s, F.coalesce(ingredients.ing_quantity(s)["n"], F.lit(0)) + 1, F.length(s)))
    u = jscompat.let(ingredients.ing_fractions(F.regexp_replace("line", "^- ", "")), lambda s: jscompat.let(behind(s), ingredients.ing_unit))
    return each_text(syn.lines(spark, sf_dir), "line", {"u": u}).select("recipe_id", "pos", "u.unit", "u.factor")

@query(f"SELECT recipe_id, pos, CASE WHEN t = 14 THEN '1/2 ' || w ELSE line END AS line FROM ({syn.LINES})")
def ing_fractions(spark, sf_dir):
    return syn.lines(spark, sf_dir).select("recipe_id", "pos", ingredients.ing_fractions(F.col("line")).alias("line"))

@query(f"SELECT recipe_id, pos, w AS name FROM ({syn.LINES})")
def ing_name(spark, sf_dir):
    """Connectors, container words and quantity hints taken off."""
    line = F.concat(F.when(F.col("v") % 2 == 0, "de gousses de ").otherwise("des "), "w", F.lit(" ( 1,5 KG )"))
    return syn.lines(spark, sf_dir).select("recipe_id", "pos", ingredients.ing_paren(ingredients.ing_container(ingredients.ing_connectors(line))).alias("name"))

@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 1 END AS DOUBLE) AS quantity, CASE p_partkey % 3 WHEN 0 THEN 'pincee' WHEN 1 THEN 'unit' END AS unit FROM part")
def ing_pinch(spark, sf_dir):
    k = F.col("p_partkey") % 3
    i = ingredients.parse_ingredient(F.when(k == 0, "Sel").when(k == 1, "sel fin").otherwise(" \u00a0"))
    return _table(spark, sf_dir, "part").select("p_partkey", i["quantity"].alias("quantity"), i["unit"].alias("unit"))

# steps

@query(r"""SELECT conv_id, turn, CAST(CASE WHEN one = '' THEN 0 WHEN len(l) >= 2 THEN len(l) WHEN len(s) >= 2 THEN len(s) ELSE 1 END AS BIGINT) AS n FROM (
SELECT conv_id, turn, one, list_filter(string_split_regex(text, '[\r\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS l, list_filter(string_split_regex(one, '[.;](?:\s+|$)'), lambda x: trim(x) <> '') AS s
FROM (SELECT conv_id, turn, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one FROM conversations))""")
def steps_split(spark, sf_dir):
    """Every turn, those of several lines too."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(steps.steps_split(F.col("text"))).cast("long").alias("n"))

@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 60 * (o_custkey % 9) + 5 WHEN 1 THEN nullif(60 * (o_custkey % 9), 0) WHEN 2 THEN nullif(o_custkey % 9, 0) END AS DOUBLE) AS minutes FROM orders")
def step_minutes(spark, sf_dir):
    n = (F.col("o_custkey") % 9).cast("string")
    s = F.element_at(F.array(F.concat(F.lit("Cuire "), n, F.lit(" heures 5 minutes")), F.concat(F.lit("Cuire "), n, F.lit(" h puis")), F.concat(F.lit("Cuire "), n, F.lit("MIN.")), F.concat(F.lit("Cuire "), n, F.lit(" mn"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", steps.step_minutes(s).alias("minutes"))

@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'étape 1: Servir' ELSE 'Servir' END AS step FROM orders")
def step_strip_index(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    s = F.concat(F.when(k == 0, F.concat(F.lit(" Etape "), F.col("o_custkey").cast("string"), F.lit(" : "))).when(k == 1, "12)").otherwise("étape 1: "), F.lit("Servir"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", steps.step_strip_index(s).alias("step"))

# classification and numbers

@query(f"SELECT recipe_id, pos, aisle FROM ({syn.LINES})")
def aisle(spark, sf_dir):
    return each_text(syn.lines(spark, sf_dir).drop("aisle"), "line", {"aisle": classify.aisle(F.col("line"))}).select("recipe_id", "pos", "aisle")

@query(f"SELECT coalesce(aisle, 'none') AS aisle, count(*) AS n, sum(quantity) AS quantity FROM ({syn.LINES}) GROUP BY ALL")
def aisle_counts(spark, sf_dir):
    of = jscompat.let(ingredients.parse_ingredient(F.col("line")), lambda i: F.struct(i["quantity"].alias("quantity"), classify.aisle(i["name"]).alias("aisle")))
    x = each_text(syn.lines(spark, sf_dir).select("line"), "line", {"x": of}).select("x.quantity", "x.aisle")
    return x.groupBy(F.coalesce("aisle", F.lit("none")).alias("aisle")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))

def _names(spark, sf_dir):
    return syn.lines(spark, sf_dir).groupBy("recipe_id").agg(F.collect_list("line").alias("names"))

@query(f"SELECT recipe_id, allergens FROM ({syn.KINDS})")
def allergens(spark, sf_dir):
    return _names(spark, sf_dir).select("recipe_id", F.array_join(classify.allergens(F.col("names")), ",").alias("allergens"))

@query(f"SELECT recipe_id, allergens FROM ({syn.KINDS})")
def allergen_rules(spark, sf_dir):
    """The allergens by rules from a table, which also holds a rule of its own for the name of every part."""
    own = spark.createDataFrame([(i, a, k) for i, (a, ks) in enumerate(ALLERGEN_RULES) for k in ks], "rank int, label string, phrase string")
    parts = _table(spark, sf_dir, "part").select(F.lit(len(ALLERGEN_RULES)).alias("rank"), F.concat(F.lit("part "), "p_partkey").alias("label"), F.col("p_name").alias("phrase"))
    lines = syn.lines(spark, sf_dir).select("recipe_id", "line")
    texts = stash(lines.select("line").distinct(), "texts")  # rules are matched with each text once
    found = classify.match_rules(texts, own.unionByName(parts), key=["line"], text="line", rule=["rank", "label"])
    named = stash(found.where(F.col("rank") < len(ALLERGEN_RULES)).groupBy("line").agg(F.collect_set(F.struct("rank", "label")).alias("some")), "named")
    every = lines.join(named, "line", "left").groupBy("recipe_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))).alias("all"))
    return every.select("recipe_id", F.array_join(F.transform("all", lambda x: x["label"]), ",").alias("allergens"))

@query(f"SELECT recipe_id, seasonal FROM ({syn.KINDS})")
def seasonal(spark, sf_dir):
    return _names(spark, sf_dir).select("recipe_id", classify.seasonal(F.col("names")).alias("seasonal"))

@query(f"SELECT recipe_id, NOT meat OR recipe_id % 9 = 0 AS vegetarian FROM ({syn.KINDS})")
def vegetarian(spark, sf_dir):
    diet = F.when(F.col("recipe_id") % 9 == 0, F.array(F.lit("https://schema.org/VeganDiet")))
    return _names(spark, sf_dir).select("recipe_id", classify.vegetarian(diet, F.col("names")).alias("vegetarian"))

@query(f"SELECT id, batch FROM ({syn.RECIPES})")
def batch_friendly(spark, sf_dir):
    r = syn.sql(spark, sf_dir, syn.RECIPES)
    return r.select("id", classify.batch_friendly(F.col("name"), F.col("description"), F.array(F.lit("Servir"))).alias("batch"))

@query("SELECT o_orderkey, CAST(nullif(d * 1440 + h * 60 + m + ceil(s / 60.0), 0) AS DOUBLE) AS minutes FROM (SELECT o_orderkey, o_orderkey % 2 AS d, o_custkey % 5 AS h, o_orderkey % 61 AS m, o_custkey % 100 AS s FROM orders)")
def iso_duration(spark, sf_dir):
    p = lambda c, n, unit: F.concat((F.col(c) % n).cast("string"), F.lit(unit))
    return _table(spark, sf_dir, "orders").select("o_orderkey", classify.iso_duration(F.concat(F.lit("P"), p("o_orderkey", 2, "D"), F.lit("T"), p("o_custkey", 5, "H"), p("o_orderkey", 61, "m"), p("o_custkey", 100, "S"))).alias("minutes"))

@query(f"SELECT id, minutes FROM ({syn.RECIPES})")
def total_minutes(spark, sf_dir):
    r = syn.sql(spark, sf_dir, syn.RECIPES)
    return r.select("id", classify.total_minutes(F.col("total_time"), F.col("prep_time"), F.col("cook_time")).alias("minutes"))

@query(f"SELECT id, servings FROM ({syn.RECIPES})")
def servings(spark, sf_dir):
    return syn.sql(spark, sf_dir, syn.RECIPES).select("id", classify.servings(F.col("yield_text")).alias("servings"))

@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE greatest(5, least(300, trunc(o_totalprice / 100))) END AS INT) AS clamped FROM orders")
def clamp_int(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 100)
    return _table(spark, sf_dir, "orders").select("o_orderkey", classify.clamp_int(v, 5, 300).alias("clamped"))

@query("SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 1000 * n WHEN 3 THEN 60000 * n + 30000 WHEN 4 THEN 3600000 * n WHEN 5 THEN 86400000 * n END AS BIGINT) AS ms FROM (SELECT o_orderkey, o_custkey % 50 AS n FROM orders)")
def duration_ms(spark, sf_dir):
    n = (F.col("o_custkey") % 50).cast("string")
    s = F.element_at(F.array(*[F.concat(n, F.lit(u)) for u in ("", "ms", "S", ".5m", "h", "d", " weeks")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", classify.duration_ms(s).alias("ms"))

# pages

def _nodes(spark, sf_dir, extract=html.extract_node):
    return syn.recipe_pages(spark, sf_dir).withColumn("x", F.explode(F.array(extract(F.col("html")))))

_LINE_LIST = f"SELECT recipe_id, md5(string_agg(line, '|' ORDER BY pos)) AS digest, count(*) AS n FROM ({syn.LINES}) GROUP BY recipe_id"

def _node_columns(p):
    steps_ = F.when(F.col("x.node").isNotNull(), F.size("x.node.step_texts").cast("long"))
    return p.select("page_id", F.col("x.node.name").alias("name"), F.col("x.node.total_time").alias("total_time"), F.col("x.node.yield_text").alias("yield_text"), F.when(F.size("x.node.lines") > 0, F.md5(F.array_join("x.node.lines", "|"))).alias("digest"), steps_.alias("n_steps"))

def _node_sql(found: str, bare: str = "false", n_steps: str = "CASE way WHEN 1 THEN 2 ELSE 3 END") -> str:
    """Every page; nulls where the form isn't ``found``, neither name nor lines where a node is ``bare``."""
    of = lambda c: f"CASE WHEN {found} THEN {c} END"
    steps_ = of(f"CAST({n_steps} AS BIGINT)")
    return f"SELECT id AS page_id, {of(f"CASE WHEN {bare} THEN '' ELSE name END")} AS name, {of('total_time')} AS total_time, {of('yield_text')} AS yield_text, {of(f'CASE WHEN NOT ({bare}) THEN digest END')} AS digest, {steps_} AS n_steps FROM ({syn.RECIPES}) r LEFT JOIN ({_LINE_LIST}) l ON id = recipe_id"

@query(_node_sql("layout IN (0, 1, 2, 4)", "layout = 4"))
def jsonld_first_recipe(spark, sf_dir):
    """JSON-LD alone, of every page; that of the fifth layout has neither name nor lines."""
    return _node_columns(_nodes(spark, sf_dir, html.extract_jsonld))

@query(_node_sql("layout IN (3, 4)", n_steps="3"))
def microdata_node(spark, sf_dir):
    """Microdata alone, of every page; the number before a list item's text counts as a sentence there."""
    return _node_columns(_nodes(spark, sf_dir, html.extract_microdata))

@query(_node_sql("layout < 5"))
def merge_nodes(spark, sf_dir):
    """Both forms of every page, merged."""
    return _node_columns(_nodes(spark, sf_dir))

@query(f"SELECT id AS page_id, CASE WHEN canonical THEN source_url END AS canonical FROM ({syn.RECIPES})")
def canonical_url(spark, sf_dir):
    return syn.recipe_pages(spark, sf_dir).select("page_id", html.canonical_url(F.col("html")).alias("canonical"))

@query(f"SELECT id AS page_id, CASE WHEN NOT canonical AND layout = 5 THEN 'https://mirror.example.net/p/' || k ELSE source_url END AS source_url FROM ({syn.RECIPES})")
def pick_source_url(spark, sf_dir):
    """Of every page the first of its own URLs, canonical or of its recipe, that resolves; all in the one pass over pages."""
    p = syn.recipe_pages(spark, sf_dir).withColumn("x", F.explode(F.array(html.extract_page(F.col("html"), F.col("url")))))
    return p.select("page_id", F.col("x.source_url").alias("source_url"))

_ERROR = "CASE WHEN layout = 5 THEN 'No recipe data found' WHEN coalesce(n_lines, 0) < 2 THEN 'Not enough ingredients extracted' END"
_RECIPE = f"SELECT r.*, k.n_lines, k.seasonal, k.meat, k.allergens, {_ERROR} AS error FROM ({syn.RECIPES}) r LEFT JOIN ({syn.KINDS}) k ON id = recipe_id"

@query(f"""SELECT id AS page_id, name, description, NOT meat OR diet AS vegetarian, CAST(greatest(5, least(300, minutes)) AS INT) AS max_prep_time, seasonal AS is_seasonal, batch AS batch_friendly,
CAST(greatest(1, least(20, servings)) AS INT) AS base_servings, allergens, n_lines AS n_ingredients, CAST(CASE way WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS n_steps,
CAST(CASE WHEN way = 1 OR (way = 2 AND layout <> 3) THEN 80 ELSE 10 END AS BIGINT) AS minutes, source_name, source_url, source_license FROM ({_RECIPE}) WHERE error IS NULL""")
def normalize_recipe(spark, sf_dir):
    r = recipe.valid(recipe.normalize_nodes(syn.recipe_pages(spark, sf_dir)))
    return r.select("page_id", "name", "description", "vegetarian", "max_prep_time", "is_seasonal", "batch_friendly", "base_servings", F.array_join("allergens", ",").alias("allergens"), F.size("ingredients").cast("long").alias("n_ingredients"), F.size("steps").cast("long").alias("n_steps"), F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["minutes"], F.lit(0))).alias("minutes"), "source_name", "source_url", "source_license")

@query(f"SELECT id AS page_id, error FROM ({_RECIPE}) WHERE error IS NOT NULL")
def recipe_errors(spark, sf_dir):
    return recipe.errors(recipe.normalize_nodes(syn.recipe_pages(spark, sf_dir), only_errors=True)).select("page_id", "error")

@query(f"SELECT 'results' AS outcome, name AS label, source_url AS detail FROM ({_RECIPE}) WHERE error IS NULL UNION ALL SELECT 'errors', CAST(id AS VARCHAR), error FROM ({_RECIPE}) WHERE error IS NOT NULL")
def dual_sink(spark, sf_dir):
    """Recipes and errors written in one pass over the pages, and read again."""
    at = shared_folder(spark, "outcomes")
    done = recipe.normalize_nodes(syn.recipe_pages(spark, sf_dir))
    sinks.write_outcomes(done, at, result=recipe.FIELDS, error=["page_id", "error"])
    good = F.col("outcome") == "results"
    read = spark.read.text(at).select("outcome", F.json_tuple("value", "name", "source_url", "page_id", "error").alias("name", "source_url", "page_id", "error"))
    return read.select("outcome", F.when(good, F.col("name")).otherwise(F.col("page_id")).alias("label"), F.when(good, F.col("source_url")).otherwise(F.col("error")).alias("detail"))

@query(f"SELECT id AS page_id, CASE WHEN error IS NULL THEN name END AS name, CASE WHEN error IS NULL THEN n_lines END AS n_ingredients, error FROM ({_RECIPE})")
def refresh_results(spark, sf_dir):
    """Recipes after two feeds of pages: first a fifth of them is empty and another fifth that of a page
    without a recipe, then they are as they should be."""
    pages = stash(syn.recipe_pages(spark, sf_dir), "pages")
    k = F.col("page_id") % 5
    first = pages.withColumn("html", F.when(k == 0, "").when(k == 1, "<title>Nothing</title>").otherwise(F.col("html")))
    store, results = cache.page_store(spark, shared_folder(spark, "store"), 8), refresh.result_store(spark, shared_folder(spark, "results"), 8)
    for n, feed in enumerate((first, pages.where(k < 2))):
        writes = feed.select(F.lit(n).cast("long").alias("seq"), "url", F.lit(n).cast("long").alias("fetched_at_ms"), F.col("url").alias("resolved_url"), F.lit(200).alias("status"), F.lit("{}").alias("headers_json"), F.col("html").alias("body"))
        store.upsert(writes, cache.cache_upsert, by_bucket=True)
        refresh.refresh(store, results)
    good = F.col("error").isNull()
    return results.frame().select(F.regexp_extract("url", "/p/([0-9]+)", 1).cast("long").alias("page_id"), F.when(good, F.col("name")).alias("name"), F.when(good, F.size("ingredients").cast("long")).alias("n_ingredients"), "error")

@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'max_prep_time' WHEN 2 THEN 'name,ingredients' ELSE 'allergens,source_url' END AS violations FROM orders")
def validate_schema(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    line = lambda q: F.struct(F.lit("Sel").alias("name"), q.alias("quantity"), F.lit("g").alias("unit"), F.lit(None).cast("string").alias("aisle"))
    step = F.struct(F.lit("Servir").alias("description"), F.lit(None).cast("bigint").alias("minutes"))
    r = {
        "name": F.when(k == 2, " ").otherwise("x"), "description": F.lit(""), "max_prep_time": F.when(k == 1, 301).otherwise(300), "base_servings": F.lit(1), "allergens": F.when(k == 3, F.array(F.lit("lait"))).otherwise(F.array(F.lit("lactose"))),
        "ingredients": F.array(line(F.lit(1.0)), line(F.when(k == 2, 0.0).otherwise(2.0))), "steps": F.array(step, step), "source_name": F.lit("a"), "source_license": F.lit("b"), "source_attribution": F.lit("c"), "source_url": F.when(k == 3, "nowhere").otherwise("https://a.org/"),
    }
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(recipe.violations(r), ",").alias("violations"))

# search

_DEDUP = f"SELECT * FROM ({syn.hits_sql(False)}) WHERE own QUALIFY row_number() OVER (PARTITION BY query_id, site_rank, url ORDER BY pos) = 1"

@query(f"SELECT query_id, site_rank, false AS from_engine, url, name FROM ({_DEDUP}) WHERE site_rank <> 1")
def itemlist_extract(spark, sf_dir):
    """Item lists of every page, the engine's too, which have none."""
    p = syn.search_pages(spark, sf_dir).withColumns({"from_engine": F.col("engine"), "engine": F.lit(False)})
    return search.page_hits(p, ["query_id", "site_rank", "from_engine"]).select("query_id", "site_rank", "from_engine", "url", "name")

@query(f"SELECT query_id, site_rank, true AS from_engine, url, name FROM ({_DEDUP})")
def anchor_results(spark, sf_dir):
    """Result links of every page, the sites' own too, which have none."""
    p = syn.search_pages(spark, sf_dir).withColumns({"from_engine": F.col("engine"), "engine": F.lit(True)})
    return search.page_hits(p, ["query_id", "site_rank", "from_engine"]).select("query_id", "site_rank", "from_engine", "url", "name")

_ANCHORS = "SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS a, unnest(t) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 1) AS a, regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 2) AS t FROM pages)"
_HREFS = f"SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(a, '(?i)\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS href, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM ({_ANCHORS})"

@query(f"SELECT * FROM ({_HREFS}) WHERE href <> ''")
def anchor_extract(spark, sf_dir):
    return search.anchors_native(_table(spark, sf_dir, "pages"), ["page_id"])

@query(f"SELECT page_id, href, name FROM ({_HREFS}) WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1")
def dedup_in_page(spark, sf_dir):
    a = search.anchors_native(_table(spark, sf_dir, "pages"), ["page_id"]).withColumnRenamed("href", "url")
    return search.dedup_in_page(a, ["page_id"]).select("page_id", F.col("url").alias("href"), "name")

def _routed(spark, sf_dir):
    pages = syn.search_pages(spark, sf_dir)
    keys = ["query_id", "site_rank", "site_id"]
    own = search.page_hits(pages.where(F.when(F.col("site_rank") > 2, F.col("engine")).otherwise(~F.col("engine"))), keys)
    more = search.page_hits(search.fallback_pages(own, pages.where("engine"), keys), keys)
    return own, more

@query(f"SELECT query_id, site_rank, url, name FROM ({_DEDUP}) WHERE site_rank = 1")
def fallback_branch(spark, sf_dir):
    return _routed(spark, sf_dir)[1].select("query_id", "site_rank", "url", "name")

@query(f"""SELECT query_id, CAST(rank AS INT) AS rank, url, name, source_name FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY site_rank, pos) AS rank FROM (
  SELECT *, {syn._case("site_rank", [syn._text(x[1]) for x in SITES])} AS source_name FROM ({_DEDUP})
  QUALIFY row_number() OVER (PARTITION BY query_id, site_rank ORDER BY pos) <= 5)) WHERE rank <= 10""")
def search_merge(spark, sf_dir):
    own, more = _routed(spark, sf_dir)
    merged = search.search_merge(own.unionByName(more), query="query_id")
    name = F.coalesce(*[F.when(F.col("site_id") == x[0], F.lit(x[1])) for x in SITES])
    return merged.select("query_id", "rank", "url", "name", name.alias("source_name"))

@query(f"""SELECT query_id, site_rank, site_id, message FROM (SELECT query_id, site_rank, {syn._case("site_rank", [syn._text(x[0]) for x in SITES])} AS site_id,
CASE (query_id + site_rank) % 5 WHEN 0 THEN 'Request failed: 503 Down' WHEN 1 THEN CASE WHEN site_rank > 2 THEN 'Invalid code point 1114112' WHEN site_rank = 1 THEN CASE WHEN query_id % 2 = 0 THEN 'DuckDuckGo fallback failed: No response' ELSE 'DuckDuckGo fallback failed: Invalid code point 1114112' END END END AS message
FROM (SELECT DISTINCT query_id, site_rank FROM ({syn.hits_sql(False)}))) WHERE message IS NOT NULL""")
def search_errors(spark, sf_dir):
    """What goes wrong with a site's page or with its fallback is an error of its own; other sites go on."""
    pages = syn.search_pages(spark, sf_dir)
    at = F.concat(F.lit("u/"), F.col("query_id").cast("string"), F.lit("/"), F.col("site_rank").cast("string"), F.lit("/"))
    k = (F.col("query_id") + F.col("site_rank")) % 5
    own = pages.where(F.when(F.col("site_rank") > 2, F.col("engine")).otherwise(~F.col("engine")))
    name = F.coalesce(*[F.when(F.col("site_id") == x[0], F.lit(x[1])) for x in SITES])
    want = own.select("query_id", "site_rank", "site_id", name.alias("source_name"), "allowed", F.concat(at, F.lit("own")).alias("search_url"), "engine", F.when(F.col("site_rank") < 2, F.concat(at, F.lit("more"))).alias("fallback_url"))
    bad = F.lit('<a class="result__a" href="//duckduckgo.com/l/?uddg=x&#x110000;">x</a>')
    first = own.select(F.concat(at, F.lit("own")).alias("url"), F.when((k == 1) & F.col("engine"), bad).otherwise(F.col("html")).alias("html"), F.col("base_url").alias("resolved_url"), F.when(k == 0, "Request failed: 503 Down").alias("fetch_error"))
    again = pages.where("site_rank = 1 and engine").select(F.concat(at, F.lit("more")).alias("url"), F.when(k == 1, bad).otherwise(F.col("html")).alias("html"), F.col("base_url").alias("resolved_url"), F.when((k == 1) & (F.col("query_id") % 2 == 0), "No response").alias("fetch_error"))
    stored = first.unionByName(again)
    return search.search_recipes(want, lambda rows: rows.join(stored, "url"), query="query_id")[1].select("query_id", "site_rank", "site_id", "message")

# cache, schedule, sinks

_RESPONSES = "SELECT event_id AS seq, 'https://h' || CAST(user_id AS STRING) || '.example.org/' || CAST(event_id % 3 AS STRING) AS url, CAST(epoch_us(ts) // 1000 AS BIGINT) AS fetched_at_ms, CAST(CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS INT) AS status, event_type AS body FROM events"

def _responses(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.org/"), (F.col("event_id") % 3).cast("string"))
    ms = F.expr("unix_millis(to_utc_timestamp(cast(ts as timestamp), 'UTC'))")
    return e.select(F.col("event_id").alias("seq"), url.alias("url"), ms.alias("fetched_at_ms"), F.when(F.col("event_id") % 5 == 0, 404).otherwise(200).alias("status"), F.col("event_type").alias("body"))

@query(f"SELECT url, max_by(fetched_at_ms, seq) AS fetched_at_ms, max_by(body, seq) AS body, max_by(status, seq) AS status FROM ({_RESPONSES}) GROUP BY url")
def cache_upsert(spark, sf_dir):
    r = _responses(spark, sf_dir)
    old = r.where("seq % 4 = 0").groupBy("url").agg(F.max_by(F.struct("fetched_at_ms", "status", "body"), "seq").alias("v")).select("url", "v.*")
    # the older entries lose against any write; where there's none they are the last write themselves
    return cache.cache_upsert(old, r).select("url", "fetched_at_ms", "body", "status")

@query(f"WITH c AS (SELECT url, max(fetched_at_ms) AS f, max_by(body, (fetched_at_ms, seq)) AS body FROM ({_RESPONSES}) WHERE seq % 2 = 0 GROUP BY url), n AS (SELECT max(f) AS now FROM c) SELECT r.seq, coalesce(n.now - c.f <= 86400000, false) AS from_cache, CASE WHEN n.now - c.f <= 86400000 THEN c.body END AS body FROM ({_RESPONSES}) r CROSS JOIN n LEFT JOIN c USING (url)")
def cache_lookup(spark, sf_dir):
    r = _responses(spark, sf_dir)
    c = r.where("seq % 2 = 0").groupBy("url").agg(F.max("fetched_at_ms").alias("fetched_at_ms"), F.max_by("body", F.struct("fetched_at_ms", "seq")).alias("body"))
    now = c.agg(F.max("fetched_at_ms")).first()[0]
    return cache.cache_lookup(r.select("seq", "url"), c, now_ms=F.lit(now), ttl_ms=86_400_000).select("seq", "from_cache", "body")

@query(f"SELECT seq, CASE WHEN seq % 11 = 0 THEN 'Request timed out after 30000ms' WHEN status = 404 THEN 'Request failed: 404 ' || CASE WHEN seq % 2 = 0 THEN 'Not Found' ELSE '' END END AS error FROM ({_RESPONSES})")
def fetch_errors(spark, sf_dir):
    """The status's text stands behind its number; without one the blank before it stays."""
    elapsed = F.when(F.col("seq") % 11 == 0, 30_001).otherwise(30_000)
    return _responses(spark, sf_dir).select("seq", cache.fetch_errors(F.col("status"), elapsed, 30_000, F.when(F.col("seq") % 2 == 0, "Not Found")).alias("error"))

_LATEST = f"SELECT url, max(fetched_at_ms) AS f, max_by(body, (fetched_at_ms, seq)) AS body, max_by(status, (fetched_at_ms, seq)) AS status, max_by(seq, (fetched_at_ms, seq)) AS s FROM ({_RESPONSES}) WHERE {{}} GROUP BY url"

@query(f"""WITH c AS ({_LATEST.format("seq % 2 = 0 AND status = 200")}), n AS (SELECT max(f) AS now FROM c), r AS ({_LATEST.format("seq % 2 = 1")}),
j AS (SELECT q.seq, q.url, coalesce(n.now - c.f <= 86400000, false) AS stored, c.f, c.body AS old, r.body AS new, r.s, n.now, q.seq = min(q.seq) OVER (PARTITION BY q.url) AS first,
  CASE WHEN r.url IS NULL THEN 'No response' WHEN r.s % 11 = 0 THEN 'Request timed out after 30000ms' WHEN r.status = 404 THEN 'Request failed: 404 Not Found' END AS wrong
  FROM ({_RESPONSES}) q CROSS JOIN n LEFT JOIN c USING (url) LEFT JOIN r USING (url)),
w AS (SELECT seq, url, wrong, now + 1500 * CAST(row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY seq) - 1 AS BIGINT) AS start_ms FROM j WHERE NOT stored AND (first OR wrong IS NOT NULL)),
d AS (SELECT url, start_ms + 5 AS done FROM w WHERE wrong IS NULL)
SELECT j.seq, start_ms IS NULL AS from_cache, CASE WHEN stored THEN old WHEN j.wrong IS NULL THEN new END AS html, CASE WHEN stored OR j.wrong IS NULL THEN 200 END AS status,
CASE WHEN stored THEN j.url WHEN j.wrong IS NULL THEN j.url || '?to=' || s END AS resolved_url, start_ms, CASE WHEN stored THEN f WHEN j.wrong IS NULL THEN done END AS fetched_at_ms, CASE WHEN NOT stored THEN j.wrong END AS error
FROM j LEFT JOIN w USING (seq) LEFT JOIN d ON d.url = j.url""")
def fetch_page(spark, sf_dir):
    """Every request from the cache while its entry is fresh; else the URL's last response, at a delay of the
    host's request before, for its first request, and for later ones what that has brought."""
    r = _responses(spark, sf_dir)
    latest = lambda x, *more: x.groupBy("url").agg(F.max_by(F.struct("fetched_at_ms", "status", "body", "seq"), F.struct("fetched_at_ms", "seq")).alias("v")).select("url", "v.*")
    kept = latest(r.where("seq % 2 = 0 and status = 200")).select("url", "fetched_at_ms", F.col("url").alias("resolved_url"), "status", F.lit("{}").alias("headers_json"), "body")
    new = latest(r.where("seq % 2 = 1")).select("url", "status", F.col("body").alias("html"), F.lit("Not Found").alias("status_text"), F.when(F.col("seq") % 11 == 0, 30_001).otherwise(5).alias("elapsed_ms"), F.concat("url", F.lit("?to="), F.col("seq").cast("string")).alias("resolved_url"))
    now = kept.agg(F.max("fetched_at_ms")).first()[0] or 0
    p = cache.fetch_pages(r.select("seq", "url"), new, kept, now_ms=now, ttl_ms=86_400_000, rate_ms=1500, jitter_ms=0)
    return p.select("seq", "from_cache", "html", "status", "resolved_url", "start_ms", "fetched_at_ms", F.col("fetch_error").alias("error"))

@query(f"""WITH RECURSIVE r AS (SELECT seq, split_part(url, '/', 3) AS host, seq % 3 AS u, fetched_at_ms AS t, user_id % 7 <> 0 AS ok, 20 + user_id % 50 AS elapsed, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY seq) AS n
  FROM (SELECT x.*, event.user_id FROM ({_RESPONSES}) x JOIN events event ON event.event_id = x.seq)),
s AS (SELECT DISTINCT host, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS d0, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS BIGINT) AS d2 FROM r
  UNION ALL
  SELECT host, n, seq, u, start_ms, CASE WHEN start_ms IS NULL THEN slot ELSE start_ms + 1500 END, CASE WHEN u = 0 AND ok AND start_ms IS NOT NULL THEN start_ms + elapsed ELSE d0 END, CASE WHEN u = 1 AND ok AND start_ms IS NOT NULL THEN start_ms + elapsed ELSE d1 END, CASE WHEN u = 2 AND ok AND start_ms IS NOT NULL THEN start_ms + elapsed ELSE d2 END
  FROM (SELECT r.host, r.n, r.seq, r.u, r.ok, r.elapsed, s.slot, s.d0, s.d1, s.d2, CASE WHEN coalesce(r.t - CASE r.u WHEN 0 THEN s.d0 WHEN 1 THEN s.d1 ELSE s.d2 END <= 864000000, false) THEN NULL ELSE greatest(r.t, coalesce(s.slot, r.t)) END AS start_ms
    FROM s JOIN r ON r.host = s.host AND r.n = s.n + 1))
SELECT seq, start_ms, start_ms IS NULL AS from_cache, CASE u WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS fetched_at_ms FROM s WHERE n > 0""")
def fetch_run(spark, sf_dir):
    """Every event is a request at its time: URLs are asked again while their answers are fresh and after.
    The SQL goes from request to request of each host."""
    r = _responses(spark, sf_dir)
    user = F.regexp_extract("url", "h([0-9]+)", 1).cast("long")
    answers = r.select("url").distinct().select("url", (user % 7 != 0).alias("ok"), (user % 50 + 20).alias("elapsed_ms"))
    plan = cache.plan_requests(r, answers, None, now_ms=0, ttl_ms=864_000_000, rate_ms=1500, jitter_ms=0, arrival="fetched_at_ms")
    return plan.select(F.col("at").alias("seq"), "start_ms", F.col("start_ms").isNull().alias("from_cache"), "fetched_at_ms")

@query(f"""WITH q AS (SELECT DISTINCT query_id * 10 + site_rank AS seq, site_rank, CASE WHEN site_rank > 2 THEN 'duckduckgo.com' ELSE 'www.' || {syn._case("site_rank", [syn._text(x[2]) for x in SITES])} END AS host FROM ({syn.hits_sql(False)})),
a AS (SELECT seq, 1 AS pass, CAST(1000000 + 1500 * (row_number() OVER (PARTITION BY host ORDER BY seq) - 1) AS BIGINT) AS start_ms FROM q)
SELECT * FROM a UNION ALL SELECT seq, 2, CAST(1000000 + 1500 * ((SELECT count(*) FROM q WHERE site_rank > 2) + row_number() OVER (ORDER BY seq) - 1) AS BIGINT) FROM q WHERE site_rank = 1""")
def search_schedule(spark, sf_dir):
    """When the sites' search pages may be asked for, and then, in a second pass of the same run, the engine's
    pages for the site that falls back on it: a host's requests keep their distance over both."""
    pages = syn.search_pages(spark, sf_dir).select("query_id", "site_rank", F.col("allowed")[0].alias("site")).distinct()
    host = F.when(F.col("site_rank") > 2, F.lit("duckduckgo.com")).otherwise(F.concat(F.lit("www."), F.col("site")))
    own = pages.select((F.col("query_id") * 10 + F.col("site_rank")).alias("seq"), F.concat(F.lit("https://"), host, F.lit("/?q="), "query_id", F.lit("-"), "site_rank").alias("url"))
    again = pages.where("site_rank = 1").select((F.col("query_id") * 10 + 1).alias("seq"), F.concat(F.lit("https://duckduckgo.com/?q=again-"), "query_id").alias("url"))
    run = cache.Run(spark, spark.createDataFrame([], "url string, status int, html string"), now_ms=1_000_000, ttl_ms=1, jitter_ms=0)
    return run(own).select("seq", F.lit(1).alias("pass"), "start_ms").unionByName(run(again).select("seq", F.lit(2).alias("pass"), "start_ms"))

@query("SELECT url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, length(html) AS n_chars, md5(html) AS digest FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 1")
def stored_responses(spark, sf_dir):
    """The pages written as stored responses and read again by the data source: those that were answered well,
    of what was sent after a filter on status that the source takes."""
    responses.register(spark)
    at = shared_folder(spark, "responses")
    k = F.col("page_id")
    pages = _table(spark, sf_dir, "pages").select("url", F.when(k % 3 == 0, 404).when(k % 4 == 1, 503).otherwise(200).alias("status"), "html")
    pages.write.format("responses").mode("append").save(at)
    got = spark.read.format("responses").load(at).where("status = 200")
    return got.select("url", "host", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest"))

@query("SELECT event_id, 'https://h' || CAST(user_id AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN '.example.org/a?b=1' WHEN 1 THEN '.example.org/' WHEN 2 THEN '.example.net/y' ELSE '.example.org/x' END AS resolved_url FROM events")
def redirects(spark, sf_dir):
    """The URL that answered, normalised; the one asked for where there's none or none that can be read."""
    host = F.concat(F.lit("https://h"), F.col("user_id").cast("string"))
    k = F.col("event_id") % 5
    upper = F.concat(F.lit("HTTPS://H"), F.col("user_id").cast("string"))
    answered = F.when(k == 0, F.concat(upper, F.lit(".Example.org:443/x/../a?b=1#top"))).when(k == 1, F.concat(host, F.lit(".example.org"))).when(k == 2, F.concat(host, F.lit(".example.net/./y"))).when(k == 3, "").otherwise("ftp://elsewhere/")
    return _table(spark, sf_dir, "events").select("event_id", cache.resolved(answered, F.concat(host, F.lit(".example.org/x"))).alias("resolved_url"))

@query("SELECT event_id, CAST(user_id AS VARCHAR) || ', b' AS accept, 'c2' AS cookie, CAST(2 AS BIGINT) AS n FROM events")
def header_capture(spark, sf_dir):
    """Headers of one name joined, of several cookies the last."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    m = cache.header_map(F.array(pair("Set-Cookie", F.lit("c1")), pair("ACCEPT", F.col("user_id").cast("string")), pair("set-cookie", F.lit("c2")), pair("accept", F.lit("b"))))
    e = _table(spark, sf_dir, "events").withColumn("m", m)
    return e.select("event_id", F.col("m")["accept"].alias("accept"), F.col("m")["set-cookie"].alias("cookie"), F.size("m").cast("long").alias("n"))

@query(f"""WITH r AS (SELECT seq, seq % 97 AS host, fetched_at_ms AS arrival_ms, 1500 + seq % 500 AS gap FROM ({_RESPONSES})),
d AS (SELECT seq, host, arrival_ms, coalesce(sum(gap) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM r)
SELECT seq, CAST(d + max(arrival_ms - d) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms FROM d""")
def rate_schedule(spark, sf_dir):
    """Every event; its SQL has the operator's windows, so a test goes request by request."""
    r = _responses(spark, sf_dir).select("seq", (F.col("seq") % 97).alias("host"), F.col("fetched_at_ms").alias("arrival_ms"))
    return cache.rate_schedule(r, delay_ms=1500, jitter=F.col("seq") % 500).select("seq", "start_ms")

@query(f"""WITH r AS (SELECT seq, seq % 97 AS host, fetched_at_ms AS arrival_ms, 1500 + seq % 500 AS gap FROM ({_RESPONSES})),
d AS (SELECT seq, host, arrival_ms, coalesce(sum(gap) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM r)
SELECT seq, CAST(d + max(arrival_ms - d) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms FROM d""")
def limiter_batches(spark, sf_dir):
    """The events in three batches, one after another, with the hosts' slots carried over: what one batch gives."""
    r = _responses(spark, sf_dir).select("seq", (F.col("seq") % 97).cast("string").alias("host"), F.col("fetched_at_ms").alias("arrival_ms"))
    jitter, end = F.col("seq") % 500, (r.agg(F.max("seq")).first()[0] or 0) + 1
    state, done = spark.createDataFrame([], cache.LIMITS), []
    for n in range(3):
        batch = r.where((F.col("seq") >= end * n // 3) & (F.col("seq") < end * (n + 1) // 3))
        rows = stash(cache.rate_schedule(batch, delay_ms=1500, jitter=jitter, state=state), "batch")
        state = cache.later_slots(state, rows.groupBy("host").agg(F.max(F.col("start_ms") + 1500 + jitter).alias("next_ms")))
        done.append(rows.select("seq", "start_ms"))
    return done[0].unionByName(done[1]).unionByName(done[2])

@query(f"SELECT url, max_by(fetched_at_ms, seq) AS fetched_at_ms, max_by(body, seq) AS body, max_by(status, seq) AS status FROM ({_RESPONSES}) GROUP BY url")
def cache_commits(spark, sf_dir):
    """Three commits to a store, the second of which comes twice, as after a restart: every URL's last write."""
    r = _responses(spark, sf_dir)
    writes = r.select("seq", "url", "fetched_at_ms", F.col("url").alias("resolved_url"), "status", F.lit("{}").alias("headers_json"), "body")
    store, end = cache.page_store(spark, shared_folder(spark, "store"), 8), (r.agg(F.max("seq")).first()[0] or 0) + 1
    for n in (0, 1, 1, 2):
        store.upsert(writes.where((F.col("seq") >= end * n // 3) & (F.col("seq") < end * (n + 1) // 3)), cache.cache_upsert, stream="events", batch=n)
    return store.frame().select("url", "fetched_at_ms", "body", "status")

@query("SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"quantity\":' || CAST(p_size AS STRING) || ',\"half\":' || CAST(p_size AS STRING) || '.5}' AS value FROM part")
def sink_jsonl(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("quantity"), (F.col("p_size") + 0.5).cast("double").alias("half"), F.lit(None).cast("string").alias("aisle"))
    return p.select("p_partkey", sinks.to_js_json(p, ["name", "quantity", "half", "aisle"]).alias("value"))

@query("SELECT '[' || string_agg('{\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS value FROM region")
def sink_json(spark, sf_dir):
    return sinks.sink_json(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")

@query("SELECT event_id, coalesce(json_extract_string(props, '$.' || key), '') AS value FROM (SELECT event_id, props, json_keys(props)[1] AS key FROM events)")
def header_decode(spark, sf_dir):
    m = cache.decode_headers(F.col("props"))
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.element_at(F.map_values(m), 1), F.lit("")).alias("value"))

