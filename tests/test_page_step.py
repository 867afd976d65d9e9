"""What the queries on pages share: one pass in Python, lines shuffled once, plain URLs and tags by one pattern."""

from brigade.functions import urls
from brigade.operators.tree import Tree
from brigade.plans import catalogue, synthetic

SF = "/root/testdata/sf0.001"


def test_source_url_in_one_pass(spark):
    plan = catalogue.QUERIES["pick_source_url"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "regexp" not in plan.lower()


def test_plain_urls_as_parsed():
    for s in ("https://a.b", "http://a.b/c?d=1#e", "/x", "/x/../y", "//c.d/", "https://xn--a.b/", "https://a.b/%2E", "http://1.2", "x", "", "#f", "/é", "https://a.b?c"):
        got, fast = (urls.url_parts(s), urls.resolve(s, "https://q.r/s")), urls._plain
        urls._plain = lambda _: None
        try:
            assert got == (urls.url_parts(s), urls.resolve(s, "https://q.r/s")), s
        finally:
            urls._plain = fast


def test_plain_tags_beside_others():
    said = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, [said(k) for k in n.kids])
    page = '<P a="1" A="2" b>x<i c=\'&lt;\'>y</I ><br/><title>t</title></P>'
    assert said(Tree(page).root)[2] == [("p", {"a": "1", "b": ""}, ["x", ("i", {"c": "<"}, ["y"]), ("br", {}, []), ("title", {}, ["t"])])]


def test_lines_of_pages_without_a_window(spark):
    plan = synthetic.recipe_pages(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
