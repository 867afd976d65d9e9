"""Pages from stored responses and a cache with a time to live: lookup, upsert, errors, the request schedule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.urls import normalize_url
from ..sources.shared import stash
from ..sources.store import Store, last_of


def cache_lookup(requests: DataFrame, cache: DataFrame, *, now_ms: Column, ttl_ms: int) -> DataFrame:
    """``requests`` (url) with the cache's columns where an entry is no older than ``ttl_ms``, and from_cache."""
    c = cache.select(*[F.col(x).alias(f"c_{x}") if x == "url" else F.col(x) for x in cache.columns])
    j = requests.withColumn("now_ms", now_ms).join(c, F.col("url") == F.col("c_url"), "left")
    fresh = F.coalesce(F.col("now_ms") - F.col("fetched_at_ms") <= ttl_ms, F.lit(False))
    values = [x for x in cache.columns if x != "url"]
    return j.select(*[x for x in requests.columns], *[F.when(fresh, F.col(x)).alias(x) for x in values], fresh.alias("from_cache"))


def decode_headers(c: Column) -> Column:
    """A header map from JSON; an empty one from anything else."""
    return F.coalesce(F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"}), F.create_map().cast("map<string,string>"))


def cache_upsert(cache: DataFrame, writes: DataFrame, *, seq: str = "seq") -> DataFrame:
    """The cache after ``writes``, the last one of each URL staying; entries of the cache come before all writes."""
    both = cache.withColumn(seq, F.lit(-1).cast("long")).unionByName(writes)
    return last_of(both, "url", [seq, "fetched_at_ms"]).drop(seq)


#: What a cache holds of each page.
STORE = "url string, fetched_at_ms long, resolved_url string, status int, headers_json string, body string"


def page_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, STORE, "url", buckets)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The cache kept at ``path`` as it is now, empty where there's none yet."""
    return page_store(spark, path).frame()


def upsert_store(writes: DataFrame, path: str, *, seq: str = "seq", buckets: int = 64, stream: str = "", batch: int = -1) -> None:
    """Commit ``writes`` (the cache's columns and ``seq``) to the cache at ``path``: several writers lose
    nothing of each other's, readers see the version before or after. The same writes once more give
    the same cache, and a batch of a stream that was committed isn't again."""
    page_store(writes.sparkSession, path, buckets).upsert(writes, lambda old, new: cache_upsert(old, new, seq=seq), stream=stream, batch=batch)


#: What is left of a run for the next one: when a host's next request may start.
LIMITS = "host string, next_ms long"


def limit_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    return Store(spark, path, LIMITS, "host", buckets)


def later_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of two tables of slots (host, next_ms) the later one of each host."""
    return old.unionByName(new).groupBy("host").agg(F.max("next_ms").alias("next_ms"))


def fetch_errors(status: Column, elapsed_ms: Column, timeout_ms: int, status_text: Column | None = None) -> Column:
    """What goes wrong with a response: a time-out, or a status other than 2xx, which is named with its text."""
    text = F.coalesce(status_text, F.lit("")) if status_text is not None else F.lit("")
    failed = F.concat(F.lit("Request failed: "), status.cast("string"), F.lit(" "), text)
    return F.when(elapsed_ms > timeout_ms, F.format_string("Request timed out after %dms", F.lit(timeout_ms))).when(~status.between(200, 299), failed)


def header_map(headers: Column) -> Column:
    """A map of lower-case names from an array of structs (name, value): values of one name are joined
    by commas, but of several set-cookie the last counts."""
    named = lambda n: F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == n), lambda h: h["value"])
    names = F.array_sort(F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"]))))
    values = F.transform(names, lambda n: F.when(n == "set-cookie", F.element_at(named(n), -1)).otherwise(F.array_join(named(n), ", ")))
    return F.coalesce(F.map_from_arrays(names, values), F.create_map().cast("map<string,string>"))


def resolved(answered: Column, asked: Column) -> Column:
    """The URL that answered after redirects, normalised; the URL asked for where it has none."""
    return F.coalesce(normalize_url(F.coalesce(F.nullif(answered, F.lit("")), asked))["url"], asked)


def default_jitter(rate_ms: int) -> int:
    """A third of the delay, half a second at most."""
    return min(500, max(0, int(rate_ms / 3)))


def request_headers(user_agent: str, accept_language: str) -> Column:
    pairs = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": accept_language, "User-Agent": user_agent}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


_LAST = (1 << 63) - 1


def _place(seq: str) -> Column:
    """A request's place in the run; requests without a number come after all others."""
    return F.coalesce(F.col(seq).cast("long"), F.lit(_LAST))


def host_of(url: str) -> Column:
    return F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)


def request_jitter(rate_ms: int, jitter_ms: int | None) -> Column | None:
    """The same wait for a URL at a place whenever it's computed; a third of the delay at most if none is named."""
    jitter_ms = default_jitter(rate_ms) if jitter_ms is None else jitter_ms
    return F.pmod(F.xxhash64("url", "at"), F.lit(jitter_ms)) if jitter_ms > 0 else None


def _scheduled(sent: DataFrame, rate_ms: int, jitter: Column | None, state: DataFrame | None) -> DataFrame:
    asked = sent.select("url", "at", "ok", "elapsed", F.col("t").alias("arrival_ms"), host_of("url").alias("host"))
    return rate_schedule(asked, delay_ms=rate_ms, jitter=jitter, seq="at", state=state)


def plan_requests(requests: DataFrame, answers: DataFrame, cache: DataFrame | None, *, now_ms: int, ttl_ms: int, rate_ms: int, jitter_ms: int | None = None, seq: str = "seq", arrival: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """What a run of ``requests`` (seq, url) in the order of seq does: rows (url, at, start_ms, stored, fetched_at_ms).

    A request whose URL was answered no longer than ``ttl_ms`` before, by an entry of ``cache`` or by an
    earlier request of the run, isn't sent (start_ms is null); ``stored`` tells which of the two,
    fetched_at_ms when. Others are sent, those of a host a delay and a jitter apart, beginning at
    its slot in ``state`` (host, next_ms). ``answers`` (url, ok, elapsed_ms) tells what comes back: what isn't
    ok is kept for no later request. ``at`` is seq, or the largest long without one; rows of the same seq
    and URL are one request. Requests arrive at ``now_ms`` or the time in ``arrival``.

    When all arrive at once, a URL is sent once, or each time if that fails. Else what is sent depends
    on when earlier answers came, that on the hosts' schedules, and those on what is sent: the three are
    computed in turn until what is sent stays. Each round is right for one more request of every host
    at least, and mostly two or three rounds do.
    """
    t = F.col(arrival).cast("long") if arrival else F.lit(now_ms).cast("long")
    keys = requests.where("url is not null").select("url", _place(seq).alias("at"), t.alias("t")).groupBy("url", "at").agg(F.min("t").alias("t"))
    known = cache.select("url", F.col("fetched_at_ms").alias("stored_at")) if cache is not None else None
    if known is not None and not arrival:
        known = known.where(F.lit(now_ms) - F.col("stored_at") <= ttl_ms)
    urls = keys.groupBy("url").agg(F.min("at").alias("first"))
    urls = urls.join(known, "url", "left") if known is not None else urls.withColumn("stored_at", F.lit(None).cast("long"))
    urls = urls.join(answers.select("url", "ok", F.col("elapsed_ms").alias("elapsed")), "url", "left").withColumns({"ok": F.coalesce("ok", F.lit(False)), "elapsed": F.coalesce("elapsed", F.lit(0)).cast("long")})
    jitter = request_jitter(rate_ms, jitter_ms)
    each = stash(keys.join(urls, "url"), "requests")
    if not arrival:
        sent = stash(_scheduled(each.where("stored_at is null and (at = first or not ok)"), rate_ms, jitter, state), "sent")
        done = sent.where("ok").select("url", (F.col("start_ms") + F.col("elapsed")).alias("done"))
        plan = each.join(sent.select("url", "at", "start_ms"), ["url", "at"], "left").join(done, "url", "left")
        return plan.select("url", "at", "start_ms", F.col("stored_at").isNotNull().alias("stored"), F.coalesce("stored_at", "done").alias("fetched_at_ms"))
    before = None
    late = lambda owner: F.coalesce(F.col("t") - F.col(owner) > ttl_ms, F.lit(True))
    while True:
        run = each.where("ok").select("url", "at", "t", "elapsed", F.col("stored_at").alias("owner"), F.lit(None).cast("long").alias("last"), F.lit(False).alias("sent"))
        while True:  # every URL's next request that finds nothing fresh
            found = run.where((F.col("last").isNull() | (F.col("at") > F.col("last"))) & late("owner"))
            found = found.groupBy("url").agg(F.min("at").alias("n"), F.min_by("t", "at").alias("nt"), F.min("elapsed").alias("wait"))
            if before is not None:
                found = found.join(before.select("url", F.col("at").alias("n"), "start_ms"), ["url", "n"], "left")
            else:
                found = found.withColumn("start_ms", F.lit(None).cast("long"))
            found = stash(found.select("url", "n", (F.coalesce("start_ms", "nt") + F.col("wait")).alias("done")), "next")
            if found.isEmpty():
                break
            j = run.join(found, "url", "left")
            after = F.coalesce(F.col("at") >= F.col("n"), F.lit(False))
            run = stash(j.select("url", "at", "t", "elapsed", F.when(after, F.col("done")).otherwise(F.col("owner")).alias("owner"), F.when(after, F.col("n")).otherwise(F.col("last")).alias("last"), (F.col("sent") | F.coalesce(F.col("at") == F.col("n"), F.lit(False))).alias("sent")), "run")
        sent = run.where("sent").select("url", "at", "t", F.lit(True).alias("ok"), "elapsed").unionByName(each.where(~F.col("ok") & late("stored_at")).select("url", "at", "t", "ok", "elapsed"))
        now = stash(_scheduled(sent, rate_ms, jitter, state).select("url", "at", "start_ms"), "sent")
        if before is not None and now.count() == before.count() and now.join(before, ["url", "at"], "left_anti").isEmpty():
            break
        before = now
    fine = run.select("url", "at", F.when(~F.col("sent"), F.col("last").isNull()).alias("stored"), F.col("owner").alias("fetched_at_ms"))
    plan = fine.unionByName(each.where("not ok").select("url", "at", F.when(~late("stored_at"), F.lit(True)).alias("stored"), F.when(~late("stored_at"), F.col("stored_at")).alias("fetched_at_ms")))
    return plan.join(now, ["url", "at"], "left").select("url", "at", "start_ms", F.coalesce("stored", F.lit(False)).alias("stored"), "fetched_at_ms")


def fetch_pages(requests: DataFrame, responses: DataFrame, cache: DataFrame | Store | None = None, *, now_ms: int, ttl_ms: int, timeout_ms: int = 30_000, rate_ms: int = 1500, jitter_ms: int | None = None, user_agent: str = "", accept_language: str = "", seq: str = "seq", arrival: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """Pages for ``requests`` (seq, url): from the cache while fresh, else from stored ``responses``, and from
    the run's own earlier answers where a URL is asked again.

    Responses have url, status and html, and may have status_text, resolved_url, headers (an array of
    name and value), elapsed_ms, and the user_agent and accept_language that they were sent with: such
    a response answers requests with the same only. Adds html, status, resolved_url, headers_json,
    fetched_at_ms (when the answer was there), from_cache, start_ms and fetch_error. A URL's responses
    should be one for each request's headers. Of a ``Store`` only the buckets of the requests' URLs are
    read. The run is planned on URLs and times alone (see ``plan_requests``); bodies are joined last, of
    entries that are fresh. Nulls: a request without a URL gets no page and no error; one without seq
    comes last.
    """
    if isinstance(cache, Store):
        cache = cache.lookup(requests, "url")
    have = responses.columns
    own = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    for c, value in (("user_agent", user_agent), ("accept_language", accept_language)):
        if c in have:
            responses = responses.where(F.col(c).isNull() | (F.col(c) == value))
    headers = F.to_json(header_map(F.col("headers"))) if "headers" in have else F.lit("{}")
    elapsed = F.coalesce(own("elapsed_ms", "long"), F.lit(0)).cast("long")
    wrong = fetch_errors(F.col("status"), elapsed, timeout_ms, own("status_text", "string"))
    answers = responses.select("url", wrong.isNull().alias("ok"), elapsed.alias("elapsed_ms")).groupBy("url").agg(F.max("ok").alias("ok"), F.max("elapsed_ms").alias("elapsed_ms"))
    plan = plan_requests(requests, answers, cache, now_ms=now_ms, ttl_ms=ttl_ms, rate_ms=rate_ms, jitter_ms=jitter_ms, seq=seq, arrival=arrival, state=state)
    plan = plan.select(F.col("url").alias("p_url"), F.col("at").alias("p_at"), "start_ms", "stored", F.col("fetched_at_ms").alias("p_fetched"))
    # the requests' own columns, whatever their names, wait in one
    j = requests.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("own"), F.col("url").alias("asked"), _place(seq).alias("place"))
    j = j.join(plan, (F.col("asked") == F.col("p_url")) & (F.col("place") == F.col("p_at")), "left")
    r = responses.select(F.col("url").alias("r_url"), F.col("status").alias("r_status"), F.col("html").alias("r_html"), own("resolved_url", "string").alias("r_resolved"), headers.alias("r_headers"), wrong.alias("r_error"))
    j = j.join(r, (F.col("asked") == F.col("r_url")) & ~F.col("stored"), "left")
    if cache is not None:
        kept = cache if arrival else cache.where(F.lit(now_ms) - F.col("fetched_at_ms") <= ttl_ms)
        kept = kept.select(F.col("url").alias("c_url"), F.col("resolved_url").alias("c_resolved_url"), F.col("status").alias("c_status"), F.col("headers_json").alias("c_headers_json"), F.col("body").alias("c_body"))
        j = j.join(kept, (F.col("asked") == F.col("c_url")) & F.col("stored"), "left")
    old = lambda c: F.col(f"c_{c}") if cache is not None else F.lit(None)
    asked = F.col("asked").isNotNull()
    sent = asked & F.col("start_ms").isNotNull()
    j = j.withColumns({"from_cache": asked & ~sent, "fetch_error": F.when(sent, F.when(F.col("r_url").isNull(), "No response").otherwise(F.col("r_error")))})
    either = lambda a, b: F.when(asked & F.col("fetch_error").isNull(), F.when(F.col("stored"), a).otherwise(b))
    return j.select(
        *[F.col("own").getField(c).alias(c) for c in requests.columns], either(old("body"), F.col("r_html")).alias("html"), either(old("status"), F.col("r_status")).alias("status"), either(old("resolved_url"), resolved(F.col("r_resolved"), F.col("asked"))).alias("resolved_url"),
        either(old("headers_json"), F.col("r_headers")).alias("headers_json"), F.when(F.col("fetch_error").isNull(), F.col("p_fetched")).alias("fetched_at_ms"), "from_cache", "start_ms", "fetch_error",
    )


class Run:
    """A run of requests in one or more passes: later passes find what earlier ones have fetched, and a
    host's requests keep their distance over all of them. Each pass is evaluated once, into the shared
    folder. ``limits`` is where slots are kept from run to run."""

    def __init__(self, spark: SparkSession, responses: DataFrame, store: Store | None = None, *, now_ms: int, ttl_ms: int, rate_ms: int = 1500, jitter_ms: int | None = 200, limits: Store | None = None, seq: str = "seq", **options):
        self.spark, self.responses, self.store, self.limits, self.seq = spark, responses, store, limits, seq
        self.rate_ms, self.jitter_ms = rate_ms, jitter_ms
        self.options = dict(now_ms=now_ms, ttl_ms=ttl_ms, seq=seq, **options)
        self.state = limits.frame() if limits else spark.createDataFrame([], LIMITS)
        self.pages: list[DataFrame] = []

    def __call__(self, requests: DataFrame) -> DataFrame:
        kept = self.store.lookup(requests, "url") if self.store else None
        for p in self.pages if self.store else ():
            kept = cache_upsert(kept, store_writes(p, seq=self.seq))
        pages = stash(fetch_pages(requests, self.responses, kept, rate_ms=self.rate_ms, jitter_ms=self.jitter_ms, state=self.state, **self.options), "pages")
        self.state = stash(later_slots(self.state, next_slots(pages, rate_ms=self.rate_ms, jitter_ms=self.jitter_ms, seq=self.seq)), "slots")
        self.pages.append(pages)
        return pages

    def sent(self) -> DataFrame:
        """(url, start_ms) of all requests that were sent."""
        out = [p.where("start_ms is not null").select("url", "start_ms") for p in self.pages]
        return reduce(DataFrame.unionByName, out)

    def remember(self) -> None:
        """Commit what was fetched to the store, and the hosts' slots to theirs."""
        if self.store and self.pages:
            writes = reduce(DataFrame.unionByName, [store_writes(p, seq=self.seq) for p in self.pages])
            self.store.upsert(writes, cache_upsert)
        if self.limits:
            self.limits.upsert(self.state, later_slots)


def next_slots(pages: DataFrame, *, rate_ms: int, jitter_ms: int | None = None, seq: str = "seq") -> DataFrame:
    """(host, next_ms): when a host's next request may start after those of fetched ``pages``."""
    jitter = request_jitter(rate_ms, jitter_ms)
    sent = pages.where("start_ms is not null").select("url", _place(seq).alias("at"), "start_ms")
    gap = F.lit(max(0, int(rate_ms))) + (jitter if jitter is not None else F.lit(0))
    return sent.groupBy(host_of("url").alias("host")).agg(F.max(F.col("start_ms") + gap).cast("long").alias("next_ms"))


def store_writes(pages: DataFrame, *, seq: str = "seq") -> DataFrame:
    """What of fetched pages goes to the cache: those that came from responses without an error."""
    new = pages.where("not from_cache and fetch_error is null and url is not null and html is not null")
    return new.select(F.col(seq).alias("seq"), "url", "fetched_at_ms", "resolved_url", "status", "headers_json", F.col("html").alias("body"))


def rate_schedule(requests: DataFrame, *, delay_ms: int, jitter: Column | None = None, host: str = "host", seq: str = "seq", arrival: str = "arrival_ms", span: int = 1 << 16, state: DataFrame | None = None) -> DataFrame:
    """``start_ms`` of each request: no earlier than its arrival or its host's slot in ``state`` (host,
    next_ms), and a host's requests at least the delay and the jitter of the one before apart. A running
    sum and a running maximum give it at once.

    Both run within ``span`` numbers of ``seq`` (whole numbers), whose totals then run over a host's
    spans: a host of any number of requests is dealt to many tasks. Requests without a number come after
    all others of their host.
    """
    gap = F.lit(max(0, int(delay_ms))) + (F.greatest(F.lit(0), jitter) if jitter is not None else F.lit(0))
    w = W.Window.partitionBy(host, "_span").orderBy("_place")
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    local = requests.withColumn("_place", _place(seq)).withColumns({"_span": F.floor(F.col("_place") / span), "_gap": gap})
    local = local.withColumn("_d", F.coalesce(F.sum("_gap").over(before), F.lit(0)))
    local = local.withColumn("_late", F.max(F.col(arrival) - F.col("_d")).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    spans = local.groupBy(F.col(host).alias("_h"), F.col("_span").alias("_s")).agg(F.sum("_gap").alias("all"), F.max("_late").alias("late"))
    over = W.Window.partitionBy("_h").orderBy("_s").rowsBetween(W.Window.unboundedPreceding, -1)
    spans = spans.withColumn("_sum", F.coalesce(F.sum("all").over(over), F.lit(0)))
    spans = spans.withColumn("_max", F.max(F.col("late") - F.col("_sum")).over(over)).select("_h", "_s", "_sum", "_max")
    if state is not None:
        spans = spans.join(state.select(F.col("host").alias("_of"), "next_ms"), F.col("_h") == F.col("_of"), "left").withColumn("_max", F.greatest("_max", "next_ms")).select("_h", "_s", "_sum", "_max")
    d = local.join(spans, F.col(host).eqNullSafe(F.col("_h")) & (F.col("_span") == F.col("_s")))
    start = F.col("_sum") + F.col("_d") + F.greatest(F.col("_max"), F.col("_late") - F.col("_sum"))
    return d.withColumn("start_ms", start.cast("long")).select(*requests.columns, "start_ms")
