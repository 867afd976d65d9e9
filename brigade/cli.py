"""Command line: ``extract`` pages to recipes and ``search`` sites, over stored responses.

Spark jobs fetch nothing: ``--responses`` names a Parquet table of fetched pages (url, status, html;
and, where known, status_text, resolved_url, headers, elapsed_ms, user_agent, accept_language), and
``--plan`` a place for a table of the requests to send, when each may start, and their headers.
"""

from __future__ import annotations

import re
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.jscompat import WS_CHARS
from .functions.rules import ENGINE_HOST, ENGINE_URL, FALLBACK_SITES, SITES
from .functions.urls import encode_component, normalize
from .operators import cache, recipe, search, sinks, sites
from .sources.shared import stash

HELP = """Usage: brigade extract <urls...> [options]
       brigade search <words...> [options] [--sites a,b] [--max-results N] [--max-results-per-site N]

Options: --responses PATH --plan PATH --output PATH --format json|jsonl --no-cache --cache-path PATH --cache-ttl DURATION
         --timeout DURATION --rate DURATION --user-agent TEXT --accept-language TEXT
Durations: 1500, 250ms, 2s, 1.5s, 2m, 1h, 1d
"""
DAY = 86_400_000
_FACTORS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": DAY}


class UsageError(Exception):
    pass


@dataclass
class Options:
    command: str
    words: list[str] = field(default_factory=list)
    format: str = "json"
    cache: bool = True
    cache_path: str = ".brigade-cache"
    cache_ttl: int = 7 * DAY
    timeout: int = 30_000
    rate: int = 1500
    user_agent: str = "brigade/1.0"
    accept_language: str = "fr-FR,fr;q=0.9,en;q=0.8"
    responses: str = "responses.parquet"
    plan: str = ""
    output: str = ""
    sites: list[str] = field(default_factory=lambda: [s[0] for s in SITES])
    max_results: int = 10
    max_results_per_site: int = 5


def parse_duration(text: str | None) -> int | None:
    raw = (text or "").strip(WS_CHARS)
    if re.fullmatch("[0-9]+", raw):
        return int(raw)
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d)", raw, re.I)
    return int(float(m[1]) * _FACTORS[m[2].lower()] + 0.5) if m else None


def _positive(text: str | None, option: str) -> int:
    m = re.match(r"\s*\+?([0-9]+)", text or "")  # digits in front are enough
    if not m or int(m[1]) <= 0:
        raise UsageError(f"{option} must be a positive integer")
    return int(m[1])


def parse_args(args: list[str]) -> Options:
    """Options of a call; UsageError with the message to print."""
    command = args[0] if args else ""
    if command not in ("extract", "search"):
        raise UsageError(f"Unknown command: {command}")
    o = Options(command, cache_ttl=DAY if command == "search" else 7 * DAY)
    rest = list(args[1:])
    texts = {"--cache-path": "cache_path", "--user-agent": "user_agent", "--accept-language": "accept_language", "--responses": "responses", "--plan": "plan", "--output": "output"}
    while rest:
        a = rest.pop(0)
        value = rest[0] if rest else None
        if a == "--no-cache":
            o.cache = False
            continue
        if not a.startswith("--"):
            o.words.append(a)
            continue
        if a == "--format":
            if value not in ("json", "jsonl"):
                raise UsageError("--format must be json or jsonl")
            o.format = value
        elif a in texts:
            if not value:
                raise UsageError(f"{a} requires a value")
            setattr(o, texts[a], value)
        elif a in ("--cache-ttl", "--timeout"):
            if not (ms := parse_duration(value)):
                raise UsageError(f"{a} must be a positive duration")
            setattr(o, a[2:].replace("-", "_"), ms)
        elif a == "--rate":
            if (ms := parse_duration(value)) is None:
                raise UsageError("--rate must be a non-negative duration")
            o.rate = ms
        elif a == "--sites" and command == "search":
            if not value:
                raise UsageError("--sites requires a value")
            o.sites = list(dict.fromkeys(x for s in value.split(",") if (x := s.strip(WS_CHARS))))
            for s in o.sites:
                if s not in [x[0] for x in SITES]:
                    raise UsageError(f"Unknown site id: {s}")
        elif a in ("--max-results", "--max-results-per-site") and command == "search":
            setattr(o, a[2:].replace("-", "_"), _positive(value, a))
        else:
            raise UsageError(f"Unknown option: {a}")
        rest.pop(0)
    if not " ".join(o.words).strip(WS_CHARS):
        raise UsageError("search requires a query" if command == "search" else "extract requires at least one URL")
    return o


def _run(spark: SparkSession, o: Options, now: int) -> cache.Run:
    store = cache.page_store(spark, o.cache_path) if o.cache else None
    return cache.Run(spark, spark.read.parquet(o.responses), store, now_ms=now, ttl_ms=o.cache_ttl, timeout_ms=o.timeout, rate_ms=o.rate, jitter_ms=None, user_agent=o.user_agent, accept_language=o.accept_language)


def _remember(o: Options, run: cache.Run) -> None:
    """Put what was fetched into the cache; write the requests and when they start where asked to."""
    if o.plan:
        run.sent().withColumn("headers", cache.request_headers(o.user_agent, o.accept_language)).write.mode("overwrite").parquet(o.plan)
    run.remember()


def extract(spark: SparkSession, o: Options, now: int):
    """(recipes in the order of the URLs, errors, the run)."""
    asked = []
    for i, u in enumerate(o.words):
        try:
            asked.append((i, u, normalize(u), None))
        except (ValueError, UnicodeError) as e:
            asked.append((i, u, None, str(e)))
    want = spark.createDataFrame(asked, "seq int, spec string, url string, bad string")
    run = _run(spark, o, now)
    pages = run(want).withColumn("fetch_error", F.coalesce("bad", "fetch_error")).withColumn("url", F.coalesce("url", "spec"))
    made = recipe.normalize_nodes(pages, keep=["seq", "url"])
    if o.output:
        return made, None, run
    done = stash(made, "recipes")
    return recipe.valid(done).select("seq", *recipe.FIELDS), recipe.errors(done).orderBy("seq").drop("seq"), run


def search_sites(spark: SparkSession, o: Options, now: int):
    """(results in rank order, errors, the run) of the sites' search pages for a query."""
    query = " ".join(o.words).strip(WS_CHARS)
    want = sites.sites(spark).where(F.col("site_id").isin(o.sites)).withColumn("search_url", sites.build_search_url(F.col("site_id"), F.lit(query)))
    # the order of --sites is the order of the results
    want = want.withColumn("site_rank", F.array_position(F.array(*map(F.lit, o.sites)), F.col("site_id")).cast("int"))
    fallback = F.concat(F.lit(ENGINE_URL), encode_component(F.concat(F.lit("site:"), F.col("host_suffixes")[0], F.lit(f" recette {query}"))))
    want = want.withColumns({"allowed": F.col("host_suffixes"), "engine": F.col("search_url").startswith(f"https://{ENGINE_HOST}/"), "fallback_url": F.when(F.col("site_id").isin(FALLBACK_SITES), fallback), "seq": F.col("site_rank")})
    run = _run(spark, o, now)
    results, failed = search.search_recipes(want.select("seq", "site_rank", "site_id", "source_name", "allowed", "search_url", "engine", "fallback_url"), run, per_site=o.max_results_per_site, total=o.max_results)
    return results.select("rank", "name", "source_name", F.col("url").alias("source_url")), failed.orderBy("site_rank").select("site_id", F.col("source_name").alias("site_name"), "search_url", "message"), run


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: int | None = None) -> int:
    """Run a command; ``now`` is the time in milliseconds, the clock's if none is given."""
    args = list(sys.argv[1:] if argv is None else argv)
    if not args or any(a in ("-h", "--help") for a in args):
        print(HELP)
        return 0
    try:
        o = parse_args(args)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    if o.output and o.command == "search":
        print("--output requires extract", file=sys.stderr)
        return 1
    rows, failed, run = (extract if o.command == "extract" else search_sites)(spark, o, now or int(time.time() * 1000))
    if o.output:  # one pass over the pages, whose numbers tell the exit code
        _, bad = sinks.write_outcomes(rows, o.output, result=recipe.FIELDS, error=["url", "error"])
        _remember(o, run)
        return int(bad > 0)
    order = rows.columns[0]
    if o.format == "jsonl":
        out = [r["value"] for r in rows.orderBy(order).select(sinks.to_js_json(rows, rows.columns[1:]).alias("value")).collect()]
    else:
        out = [r["value"] for r in sinks.sink_json(rows, order, always_array=o.command == "search").collect()]
    for line in out:
        print(line)
    bad = failed.collect()
    _remember(o, run)
    for r in bad:
        print(" | ".join(str(x) for x in r), file=sys.stderr)
    return int(bool(bad))


__all__ = ["main", "parse_args", "parse_duration"]

if __name__ == "__main__":
    sys.exit(main())
