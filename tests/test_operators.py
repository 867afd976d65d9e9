import json

import pytest
from pyspark.sql import functions as F

from brigade import cli
from brigade.functions import text, urls
from brigade.operators import classify, html, search, steps
from brigade.operators.cache import rate_schedule
from brigade.operators.ingredients import parse_ingredient
from brigade.operators.recipe import normalize_nodes
from brigade.operators.tree import Tree


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.coalesce(1).select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


LINES = {
    "200 g de riz": ("Riz", 200.0, "g"), "2 gélatine": ("Élatine", 2.0, "g"), "2 légumes": ("Égumes", 2.0, "l"), "350g de riz": ("350g de riz", 1.0, "unit"), "1.5kg x": (".5kg x", 1.0, "unit"),
    "2-3kg x": ("-3kg x", 2.0, "unit"), "1½ l d'eau": ("Eau", 5.5, "l"), "1 ½ l d’eau": ("Eau", 1.5, "l"), "1/0 x": ("/0 x", 1.0, "unit"), "0 g x": ("X", 1.0, "g"), "gousses d'ail": ("Gousses d'ail", 1.0, "unit"),
    "2 gousses de ail": ("Ail", 2.0, "unit"), "Sel": ("Sel", 1.0, "pincee"), "• 2 à 4 c. à café de sel": ("Sel", 3.0, "cc"), "riz (400 g) long": ("Riz   long", 1.0, "unit"), "50 cl de lait": ("Lait", 500.0, "ml"), " ": None, None: None,
}


def test_ingredient_lines(spark):
    got = column(spark, list(LINES), parse_ingredient)
    assert [g and tuple(g) for g in got] == list(LINES.values())


def test_steps(spark):
    assert column(spark, ["1. Cuire les pates.", "a\r\nb", "  ", "Un. Deux; Trois.", "v1.5"], steps.steps_split) == [["1", "Cuire les pates"], ["a", "b"], [], ["Un", "Deux", "Trois"], ["v1.5"]]
    assert column(spark, ["1.5 kg x", "10-15 min", "étape 1: x", "Step 2 : y"], steps.step_strip_index) == ["5 kg x", "15 min", "étape 1: x", "y"]
    said = {"30 min puis 1 h": 60, "1/2 h": 120, "Reposer 1 h 2 fois": 62, "0 h 0 puis 5 min": None, "5 mins": None, "15 mn": None, "1 heure et 30 minutes": 60}
    assert column(spark, list(said), steps.step_minutes) == list(said.values())
    assert steps.flatten([{"text": ""}, {"itemListElement": []}, {"@type": "HowToStep", "name": "n"}, {"@type": "schema:HowToStep", "name": "m"}, "a. b."]) == ["", "n", "a", "b"]


def test_numbers(spark):
    assert column(spark, ["PT1H30M", "p1dt1s", "PT0M", "P", "P1W", "PT61S", None], classify.iso_duration) == [90, 1441, None, None, None, 2, None]
    assert column(spark, [float("inf"), -1.5, 9.9, 1e9, float("nan"), None], lambda c: classify.clamp_int(c, 5, 300), "double") == [5, 5, 9, 300, 5, 5]
    assert column(spark, ["1500", "1.5s", "2M", "1.5", "1w"], classify.duration_ms) == [1500, 1500, 120000, None, None]
    assert [cli.parse_duration(x) for x in ("1500", "1.5s", "2M", "1.5", "")] == [1500, 1500, 120000, None, None]


def test_keywords(spark):
    assert column(spark, ["laitue", "laits", "Noi", "ju", "pois chichesx", "ŒUFS"], classify.aisle) == [None, "cremerie", None, "boissons", "epicerie", "cremerie"]
    assert column(spark, [["noi", "blé"], ["laitue"]], classify.allergens, "array<string>") == [["gluten", "fruits_a_coque"], []]
    assert column(spark, ["à l’avance", "recongeler"], lambda c: classify.batch_friendly(c, F.lit(""), F.array(F.lit("")))) == [False, True]


def test_entities(spark):
    assert column(spark, ["&amp;lt;", "&#38;lt;", "&#x110000;", "&nbsp;", None], text.decode_entities) == ["&lt;", "<", None, "&nbsp;", None]


@pytest.mark.parametrize(
    "spec,url",
    [("Example.COM", "https://example.com/"), ("http://a.b:80/x/../y?q=é#f", "http://a.b/y?q=%C3%A9"), ("https://1.2.3/", "https://1.2.0.3/"), ("https://bücher.example/", "https://xn--bcher-kva.example/"), ("https:\\\\a.b\\c", "https://a.b/c")],
)
def test_urls(spec, url):
    assert urls.normalize(spec) == url


@pytest.mark.parametrize("spec", ["", "example.com:8080/x", "localhost:3000", "ftp://a/", "https://a b/"])
def test_bad_urls(spec):
    with pytest.raises(ValueError):
        urls.normalize(spec)


def test_resolve():
    assert urls.resolve("/r/1", "https://a.b/c/d?q") == "https://a.b/r/1" and urls.resolve("//x.y", "http://a.b/") == "http://x.y/" and urls.resolve("mailto:a", "https://a.b/") is None


def test_jsonld_order_and_strictness():
    page = '<script data-type="application/ld+json">{"b":{"@type":"Recipe","name":"b"},"1":{"@type":["x","schema.org/Recipe"],"name":"one"}}</script>'
    assert html.page_node(page)["node"]["name"] == "one"
    for bad in ("{'a':1}", '{"@type":"Recipe"} x', '{"@type":"Recipe","x":NaN}'):
        assert html.page_node(f'<script type="application/ld+json">{bad}</script>')["node"] is None
    assert html.page_node(None) == {"node": None, "error": None}


def test_microdata_and_merge():
    page = '<div itemscope itemtype="http://schema.org/Recipe"><p itemprop=author itemscope><b itemprop="name">A</b></p><h1 itemprop=name>B</h1><meta itemprop=description content="  "><i itemprop=description>d</i></div>'
    assert html.microdata_node(page) == {"name": "A"}
    assert html.merge_nodes({"name": " ", "recipeYield": [4]}, {"name": " x ", "recipeYield": "6"}) == {"name": "x", "recipeYield": "6", "recipeIngredient": [], "recipeInstructions": []}
    assert html.merge_nodes({"a": None}, {"a": 1})["a"] is None and html.merge_nodes(None, {"a": 1}) == {"a": 1}


def test_search_links():
    page = '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": ["/a", {"@id": "/b", "name": " "}, {"item": {"url": "/c", "@id": "/d", "name": "D"}}]}) + "</script>"
    assert search.itemlist_links(page, "https://x.y/") == [("https://x.y/a", None), ("https://x.y/b", None), ("https://x.y/d", "D")]
    assert search.unwrap("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2F%2541", "https://x.y/") == "https://a.b/%41" and search.unwrap("https://duckduckgo.com/y", "https://x.y/") is None


def test_rate_schedule(spark):
    rows = [(1, "a", 0), (2, "b", 10), (3, "a", 100), (4, "a", 5000)]
    got = rate_schedule(spark.createDataFrame(rows, "seq long, host string, arrival_ms long"), delay_ms=1500).orderBy("seq").collect()
    assert [r["start_ms"] for r in got] == [0, 10, 1500, 5000]


def test_recipe_plan_has_no_shuffle_and_one_pass(spark):
    pages = spark.createDataFrame([(1, "https://a.b/", "<title>t</title>")], "page_id long, url string, html string")
    plan = normalize_nodes(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("extract_page(") == plan.count("ArrowEvalPython") == 1
    assert normalize_nodes(pages).first()["error"] == "No recipe data found"


def test_cli(spark, tmp_path, capsys):
    node = {"@type": "Recipe", "name": "Riz", "recipeIngredient": ["200 g de riz", "sel"], "recipeInstructions": "Cuire 10 min. Servir.", "totalTime": "PT20M"}
    pages = [("https://a.b/x", 200, f'<script type="application/ld+json">{json.dumps(node)}</script>'), ("https://a.b/y", 404, "")]
    spark.createDataFrame(pages, "url string, status int, html string").write.parquet(path := str(tmp_path / "r.parquet"))
    assert cli.main(["extract", "a.b/x", "a.b/y", "--responses", path, "--no-cache"], spark) == 1
    out = capsys.readouterr()
    got = json.loads(out.out)
    assert got["ingredients"][0] == {"name": "Riz", "quantity": 200, "unit": "g", "aisle": "epicerie"} and "Request failed: 404" in out.err
    assert [cli.main(a, spark) for a in (["nope"], ["extract"], ["search", "x", "--max-results", "0"], ["search", "x", "--sites", "q"], ["extract", "u", "--cache-ttl", "0"])] == [1] * 5
    assert cli.parse_args(["search", "a", "b", "--max-results", "10abc", "--rate", "0"]).max_results == 10


def test_tree_as_the_standard_builds_it():
    def show(n):
        return "".join(k if isinstance(k, str) else f"<{k.tag}>{show(k)}</{k.tag}>" for k in n.kids)

    built = {
        "<p>1<b>2<i>3</b>4</i>5</p>": "<p>1<b>2<i>3</i></b><i>4</i>5</p>", "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>", "<a>x<a>y</a>z": "<a>x</a><a>y</a>z", "<b><em>x<p>y</b>z</p>": "<b><em>x</em></b><em><p><b>y</b>z</p></em>",
        "<div><table>x<tr><td>1</div>2<td>3</table>4</div>5": "<div>x<table><tbody><tr><td>12</td><td>3</td></tr></tbody></table>4</div>5", "<p>a<div>b</div>c</p>d": "<p>a</p><div>b</div>c<p></p>d", "<h1>a<h2>b</h1>c": "<h1>a</h1><h2>b</h2>c",
        "<ul><li>1<li>2<ul><li>3</ul><li>4</ul>": "<ul><li>1</li><li>2<ul><li>3</li></ul></li><li>4</li></ul>", "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>", "<tr><td>x</td>": "x", "<table><col><caption>c</table>": "<table><colgroup><col></col></colgroup><caption>c</caption></table>",
    }
    assert {p: show(Tree(p).root) for p in built} == built
    deep = Tree("<div>" * 5000 + "x").root
    assert deep.text() == "x"


def test_microdata_of_misnested_pages():
    page = '<div itemscope itemtype="http://schema.org/Recipe"><table><tr><td></div><h1 itemprop="name">N</h1><b itemprop="description">one<p>two</b>three</p></td></tr><li itemprop="recipeIngredient">riz<li itemprop="recipeIngredient">sel</table></div>'
    assert html.microdata_node(page) == {"name": "N", "description": "one", "recipeIngredient": ["riz", "sel"]}
