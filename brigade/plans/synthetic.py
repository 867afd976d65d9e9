"""Inputs for the registered queries, made from the driver's tables by SQL text that Spark and DuckDB
both read, with what the operators must find stated beside it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import ENGINE_URL, SITES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: ingredient, aisle, allergen, in season, meat or fish
VOCABULARY = [
    ("farine", "epicerie", "gluten", 0, 0), ("beurre", "cremerie", "lactose", 0, 0), ("lait de coco", "cremerie", "lactose", 0, 0), ("œufs", "cremerie", "oeuf", 0, 0),
    ("poulet fermier", "boucherie_poisson", None, 0, 1), ("saumon fumé", "boucherie_poisson", "poisson", 0, 1), ("noix", None, "fruits_a_coque", 0, 0), ("pois chiches", "epicerie", None, 0, 0),
    ("crème fraîche", "cremerie", "lactose", 0, 0), ("vinaigre de vin", "boissons", None, 0, 0), ("fraises", "fruits_legumes", None, 1, 0), ("asperges vertes", "fruits_legumes", None, 1, 0),
    ("sauce soja", None, "soja", 0, 0), ("pâtes", "epicerie", "gluten", 0, 0), ("orange pressée", "fruits_legumes", None, 0, 0), ("crevettes", "boucherie_poisson", "crustaces", 0, 1),
    ("veau", "boucherie_poisson", None, 0, 0), ("film alimentaire", "entretien", None, 0, 0), ("laitue", None, None, 0, 0), ("pain complet", "boulangerie", "gluten", 0, 0),
    ("petits pois surgelés", "surgeles", None, 0, 0), ("sésame", None, "sesame", 0, 0), ("cacahuètes", None, "arachide", 0, 0), ("levure", "epicerie", None, 0, 0),
]

#: line, quantity, unit, name; q is the quantity's digits, w the ingredient, c the ingredient capitalised
TEMPLATES = [
    ("q || ' g de ' || w", "n", "g", "c"), ("q || ' kg ' || w", "n", "kg", "c"), ("q || ' cl de ' || w", "n * 10", "ml", "c"), ("q || ' ml de ' || w", "n", "ml", "c"),
    ("q || ' litres de ' || w", "n", "l", "c"), ("q || ' c. à soupe de ' || w", "n", "cs", "c"), ("q || ' cuillères à café de ' || w", "n", "cc", "c"), ("q || ' pincées de ' || w", "n", "pincee", "c"),
    ("q || '-' || CAST(n + 2 AS STRING) || ' ' || w", "n + 1", "unit", "c"), ("q || ' 1/2 ' || w", "n + 0.5", "unit", "c"), ("'1/4 ' || w", "0.25", "unit", "c"), ("'deux ' || w", "2", "unit", "c"),
    ("'- ' || q || ' g de ' || w", "n", "g", "c"), ("q || ' ' || w || ' (400 g)'", "n", "unit", "c"), ("'½ ' || w", "0.5", "unit", "c"), ("'350g de ' || w", "1", "unit", "'350g de ' || w"),
]


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


def _text(x) -> str:
    return "NULL" if x is None else "'" + x + "'"


#: recipe_id, pos, line, and the quantity, unit, name and aisle that it stands for
LINES = f"""
SELECT recipe_id, pos, n, t, v, w, {_case("t", [x[0] for x in TEMPLATES])} AS line,
       CAST({_case("t", [f"CAST({x[1]} AS DOUBLE)" for x in TEMPLATES])} AS DOUBLE) AS quantity,
       {_case("t", [_text(x[2]) for x in TEMPLATES])} AS unit, {_case("t", [x[3] for x in TEMPLATES])} AS name,
       {_case("v", [_text(x[1]) for x in VOCABULARY])} AS aisle
FROM (SELECT *, CAST(n AS STRING) AS q, {_case("v", [_text(x[0]) for x in VOCABULARY])} AS w,
             {_case("v", [_text(x[0][0].upper() + x[0][1:]) for x in VOCABULARY])} AS c
      FROM (SELECT l_orderkey AS recipe_id, CAST(l_quantity AS INT) AS n, l_partkey % 16 AS t, l_suppkey % 24 AS v,
                   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos
            FROM {{lineitem}}) a) b"""

#: The lines with what orders them within a recipe as ``pos``.
ORDERED = re.sub(r"CAST\(row_number\(\) OVER \(PARTITION BY l_orderkey ORDER BY (.*)\) AS BIGINT\) AS pos", r"struct(\1) AS pos", LINES)


def _any(which) -> str:
    return "v IN (" + ", ".join(str(i) for i, x in enumerate(VOCABULARY) if which(x)) + ")"


#: per recipe: what its ingredients make of it
KINDS = f"""
SELECT recipe_id, count(*) AS n_lines, max(CASE WHEN {_any(lambda x: x[3])} THEN 1 ELSE 0 END) = 1 AS seasonal,
       max(CASE WHEN {_any(lambda x: x[4])} THEN 1 ELSE 0 END) = 1 AS meat,
       concat_ws(',', {", ".join(f"CASE WHEN max(CASE WHEN {_any(lambda x, a=a: x[2] == a)} THEN 1 ELSE 0 END) = 1 THEN '{a}' END" for a in ("gluten", "lactose", "oeuf", "arachide", "fruits_a_coque", "soja", "poisson", "crustaces", "sesame"))}) AS allergens
FROM ({LINES}) l GROUP BY recipe_id"""

_SITE = _case("s", [_text(x[2]) for x in SITES])
#: per order: the recipe's texts, times and yield, and what they come to
RECIPES = f"""
SELECT *, CASE WHEN canonical THEN CASE WHEN s < 6 THEN 'https://www.' || site || '/recettes/plat-' || k || '.html' ELSE 'https://cuisine.example.org/plat-' || k END
               ELSE 'https://mirror.example.net/r/' || k END AS source_url,
       CASE WHEN canonical AND s < 6 THEN {_case("s", [_text(x[1]) for x in SITES])} WHEN canonical THEN 'cuisine.example.org' ELSE 'mirror.example.net' END AS source_name,
       CASE WHEN canonical AND s < 6 THEN 'proprietary' ELSE 'unknown' END AS source_license
FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS k, o_orderkey % 8 AS s, o_orderkey % 2 = 0 AS canonical, o_orderkey % 6 AS layout, o_orderkey % 3 AS way,
             'Recette ' || CAST(o_orderkey AS STRING) AS name, 'Plat du jour' || CASE WHEN o_orderkey % 5 = 0 THEN ', se congèle bien' ELSE '' END AS description,
             o_orderkey % 5 = 0 AS batch, o_orderkey % 9 = 0 AS diet, {_case("o_orderkey % 8", [_text(x[2]) for x in SITES])} AS site,
             CASE o_custkey % 6 WHEN 0 THEN 'PT' || m || 'M' WHEN 1 THEN 'PT1H' || m || 'M' WHEN 5 THEN 'P1D' END AS total_time,
             CASE WHEN o_custkey % 6 = 2 THEN 'PT10M' WHEN o_custkey % 6 = 3 THEN 'PT' || m || 'M' END AS prep_time,
             CASE WHEN o_custkey % 6 = 2 THEN 'pt' || m || 'm30s' END AS cook_time,
             CAST(CASE o_custkey % 6 WHEN 0 THEN n WHEN 1 THEN 60 + n WHEN 2 THEN 11 + n WHEN 3 THEN n WHEN 4 THEN 30 ELSE 1440 END AS DOUBLE) AS minutes,
             CASE o_custkey % 4 WHEN 0 THEN y || ' personnes' WHEN 1 THEN 'Pour ' || y WHEN 3 THEN '0' END AS yield_text,
             CAST(CASE WHEN o_custkey % 4 < 2 THEN people ELSE 4 END AS DOUBLE) AS servings
      FROM (SELECT *, CAST(o_custkey % 90 + 1 AS STRING) AS m, o_custkey % 90 + 1 AS n, CAST(o_custkey % 25 + 1 AS STRING) AS y, o_custkey % 25 + 1 AS people FROM {{orders}}) o) r"""


def sql(spark: SparkSession, sf_dir: str, text: str, *more: DataFrame) -> DataFrame:
    """Run shared SQL text over the driver's tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LINES)


def recipe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, layout): JSON-LD plain, in a graph, with a type array; microdata; both; neither."""
    r = sql(spark, sf_dir, RECIPES)
    # grouped by what a line's position is counted by, in place of the position, so that lines are shuffled once
    ing = sql(spark, sf_dir, ORDERED).groupBy("recipe_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"].alias("lines"))
    # orders come in one split, and what follows is work on each page
    r = r.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    p = r.join(ing, r.id == ing.recipe_id, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    text = {0: "Préparer. Cuire 10 min. Servir.", 2: "Préparer\n2) Cuire 1 h 20\nServir"}
    both = F.array(F.struct(F.lit("HowToStep").alias("@type"), F.lit("1. Mélanger").alias("text")), F.struct(F.lit("HowToStep").alias("@type"), F.lit("Cuire 1 h 20").alias("text")))
    steps = F.when(F.col("way") == 1, F.to_json(both)).otherwise(F.to_json(F.array(F.when(F.col("way") == 0, text[0]).otherwise(text[2]))))
    bare = F.col("layout") == 4
    head = F.to_json(F.struct(
        F.when(bare, "").otherwise(F.col("name")).alias("name"), "description", F.col("total_time").alias("totalTime"), F.col("prep_time").alias("prepTime"), F.col("cook_time").alias("cookTime"),
        F.col("yield_text").alias("recipeYield"), F.when(F.col("diet"), "https://schema.org/VegetarianDiet").alias("suitableForDiet"), F.concat(F.lit("/r/"), "k").alias("url"), F.when(~bare, F.col("lines")).alias("recipeIngredient"),
    ))
    kind = F.when(F.col("layout") == 2, '["Thing","schema:Recipe"]').otherwise('"Recipe"')
    node = F.concat(F.lit('{"@type":'), kind, F.lit(',"recipeInstructions":'), steps, F.lit(","), F.substring(head, 2, 1 << 30))
    node = F.when(F.col("layout") == 1, F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"x"},'), node, F.lit("]}"))).otherwise(node)
    script = F.concat(F.lit('<script type="application&#x2F;ld+json; charset=utf-8">\n<!-- '), node, F.lit(" --></script>"))
    meta = lambda prop, c: F.coalesce(F.concat(F.lit(f'<meta itemprop="{prop}" content="'), c, F.lit('">')), F.lit(""))
    items = F.when(F.col("way") == 1, '<ol itemprop="recipeInstructions"><li>1. Mélanger<li>Cuire 1 h 20</ol>').otherwise('<div itemprop="recipeInstructions">Préparer. Cuire  10 min.\n Servir.</div>')
    micro = F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/Recipe"><h1 itemprop="name"> '), "name", F.lit("</h1>"), meta("description", F.col("description")), meta("totalTime", F.col("total_time")), meta("prepTime", F.col("prep_time")), meta("cookTime", F.col("cook_time")),
        meta("recipeYield", F.col("yield_text")), F.when(F.col("diet"), '<link itemprop="suitableForDiet" href="https://schema.org/VegetarianDiet">').otherwise(""), F.lit('<a itemprop="url" href="/r/'), "k", F.lit('">x</a><ul>'),
        F.array_join(F.transform("lines", lambda x: F.concat(F.lit('<li itemprop="recipeIngredient">'), x)), ""), F.lit("</ul>"), items, F.lit("</div>"),
    )
    link = F.when(F.col("canonical"), F.concat(F.lit("<LINK href='"), "source_url", F.lit("' rel=canonical>"))).otherwise("")
    html = F.concat(F.lit("<html><head><title> Page "), "k", F.lit(" </title>"), link, F.when(F.col("layout").isin(0, 1, 2, 4), script).otherwise(""), F.lit("</head><body>"), F.when(F.col("layout").isin(3, 4), micro).otherwise(""), F.lit("</body></html>"))
    return p.select(F.col("id").alias("page_id"), F.concat(F.lit("https://mirror.example.net/p/"), "k", F.lit("#top")).alias("url"), html.alias("html"), "layout")


#: query_id, site_rank, pos, url, name: what search pages list, some of it twice and some on a foreign host
HITS = f"""
SELECT query_id, site_rank, pos, name, 'https://' || CASE WHEN k % 7 = 0 THEN 'ads.example.com' ELSE 'www.' || {_case("site_rank", [_text(x[2]) for x in SITES])} END || '/recettes/r-' || CAST(k % 53 AS STRING) AS url,
       k % 7 <> 0 AS own
FROM (SELECT p_partkey AS k, p_partkey // 300 AS query_id, p_partkey % 6 AS site_rank, p_name AS name,
             CAST(row_number() OVER (PARTITION BY p_partkey // 300, p_partkey % 6 ORDER BY p_partkey) AS BIGINT) AS pos FROM {{part}}) h"""


def hits_sql(spark: bool) -> str:
    return HITS.replace("p_partkey // 300", "CAST(floor(p_partkey / 300) AS BIGINT)") if spark else duck(HITS)


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, site_rank, site_id, html, base_url, engine, allowed): the sites' own pages, of which
    the second is always empty, and the engine's pages for the last three and as the second's fallback."""
    hits = sql(spark, sf_dir, hits_sql(True))
    site = lambda i: F.coalesce(*[F.when(F.col("site_rank") == r, F.lit(x[i])) for r, x in enumerate(SITES)])
    listed = hits.groupBy("query_id", "site_rank").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "name"))).alias("h"))
    items = F.to_json(F.transform("h", lambda x: F.struct(x["pos"].alias("position"), F.struct(x["url"].alias("@id"), x["name"].alias("name")).alias("item"))))
    own = F.concat(F.lit('<script type="application/ld+json">{"@type":"http://schema.org/ItemList","itemListElement":'), F.when(F.col("site_rank") == 1, "[]").otherwise(items), F.lit("}</script>"))
    anchor = lambda x: F.concat(F.lit('<a class="x result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(x["url"]), F.lit('&amp;rut=1"> <b>'), x["name"], F.lit("</b>\n</a>"))
    engine = F.array_join(F.transform("h", anchor), "\n")
    pages = listed.select("query_id", "site_rank", site(0).alias("site_id"), F.array(site(2)).alias("allowed"), F.posexplode(F.array(own, engine)).alias("e", "html"))
    return pages.select("query_id", "site_rank", "site_id", "allowed", "html", (F.col("e") == 1).alias("engine"), F.when(F.col("e") == 1, ENGINE_URL).otherwise(F.concat(F.lit("https://www."), F.col("allowed")[0], F.lit("/"))).alias("base_url"))
