"""Search result pages: flattening of cached pages, and a data source that reads pages through a client.

A page source is one input partition per labelled query, so queries run in parallel and pages of one query in order. The
client is injected (a callable from query and cursor to a page), which keeps the reader testable without a network.

`collect_pages` keeps the pages in a table partitioned by label and reads on from what is there: the state of a query is
its last stored page, so state and pages cannot disagree. A query that is done is replayed, one that broke off goes on at
its cursor, and one whose text has changed starts anew.
"""

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GRAPH_PAGE = (
    "label string, seq long, search struct<repositoryCount:int,pageInfo:struct<hasNextPage:boolean,endCursor:string>,nodes:array<struct<id:string,nameWithOwner:string,url:string,description:string,stargazerCount:int,forkCount:int,"
    "isFork:boolean,isArchived:boolean,pushedAt:string,createdAt:string,primaryLanguage:struct<name:string>,languages:struct<nodes:array<struct<name:string>>>,repositoryTopics:struct<nodes:array<struct<topic:struct<name:string>>>>,"
    "defaultBranchRef:struct<name:string,target:struct<oid:string>>,licenseInfo:struct<spdxId:string>>>>"
)
CODE_PAGE = "label string, seq long, total_count int, incomplete_results boolean, items array<struct<path:string,score:double,repository:struct<full_name:string,fork:boolean,description:string>>>"


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def candidates_of_pages(pages: DataFrame) -> DataFrame:
    """Candidates of graph pages: one row per node, null-safe, with the page's label as matched signal."""
    n = pages.select("label", "seq", F.posexplode("search.nodes").alias("pos", "n")).where("n is not null")
    names = lambda c, path: F.coalesce(F.transform(c, lambda x: path(x)), F.array().cast("array<string>"))
    return n.select(
        F.col("n.id").alias("id"), F.col("n.nameWithOwner").alias("name_with_owner"), F.col("n.url").alias("url"), F.col("n.description").alias("description"), F.col("n.stargazerCount").alias("stargazer_count"), F.col("n.forkCount").alias("fork_count"),
        F.col("n.isFork").alias("is_fork"), F.col("n.isArchived").alias("is_archived"), F.col("n.pushedAt").alias("pushed_at"), F.col("n.createdAt").alias("created_at"), F.col("n.primaryLanguage.name").alias("primary_language"),
        names(F.col("n.languages.nodes"), lambda x: x["name"]).alias("languages"), names(F.col("n.repositoryTopics.nodes"), lambda x: x["topic"]["name"]).alias("topics"),
        F.col("n.defaultBranchRef.name").alias("default_branch"), F.col("n.defaultBranchRef.target.oid").alias("default_branch_oid"), F.col("n.licenseInfo.spdxId").alias("license_spdx_id"),
        F.array("label").alias("matched_signals"), (F.col("seq") * 1000 + F.col("pos")).alias("seq"),
    )


def code_hits(pages: DataFrame) -> DataFrame:
    """name_with_owner and all its signals of cached code pages, forks left out; most signals first."""
    rows = pages.select("label", F.explode("items").alias("i")).select("label", F.col("i.repository.full_name").alias("name_with_owner"), F.coalesce("i.repository.fork", F.lit(False)).alias("fork"))
    rows = rows.where("name_with_owner is not null and not fork").distinct()
    return rows.groupBy("name_with_owner").agg(F.array_sort(F.collect_set("label")).alias("signals"), F.countDistinct("label").alias("n_signals")).orderBy(F.desc("n_signals"), "name_with_owner")


def first_signal(pages: DataFrame, order: list[str]) -> DataFrame:
    """The other mode: each repository for the first signal, in the given order, that hit it."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("label"))
    rows = pages.select("label", F.explode("items").alias("i")).select(F.col("i.repository.full_name").alias("name_with_owner"), "label", rank.alias("rank")).where("name_with_owner is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("name_with_owner").orderBy("rank"))).where("n = 1").select("name_with_owner", "label")


def last_hydration(lines: DataFrame) -> DataFrame:
    """The last line per key of an append-only cache (key, line_no, value)."""
    return lines.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def queries_for(signals: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(label, query) of each distinct pair of signal and file qualifier."""
    seen: dict[str, str] = {}
    for signal, qualifiers in signals:
        for q in qualifiers:
            seen.setdefault(f"{signal}|{q}", f'"{signal}" {q}')
    return list(seen.items())


def topic_query(topic: str, min_stars: int) -> str:
    return f"topic:{topic} fork:false stars:>={min_stars}"


def text_query(signal: str, min_stars: int) -> str:
    return f'"{signal}" in:readme,description fork:false stars:>={min_stars}'


def repository_queries(topics: list[str], signals: list[str], min_stars: int) -> list[tuple[str, str]]:
    """(label, query) of every topic and every text signal."""
    return [(f"topic:{t}", topic_query(t, min_stars)) for t in topics] + [(f"text:{x}", text_query(x, min_stars)) for x in signals]


Client = Callable[[str, str | None], dict]


class RateLimited(Exception):
    """Raised by a client that must wait until `reset_at` (seconds since the epoch)."""

    def __init__(self, reset_at: float):
        super().__init__(f"rate limit until {reset_at}")
        self.reset_at = reset_at


class NotFound(Exception):
    """Raised by a client for something that no longer exists."""


class _Partition(InputPartition):
    def __init__(self, label: str, query: str, cursor: str | None = None, page_no: int = 0):
        self.label, self.query, self.cursor, self.page_no = label, query, cursor, page_no


PAGE = "label string, query string, page_no int, page string, end_cursor string, has_next boolean"


class PageReader(DataSourceReader):
    """Reads the pages of each query in order, `max_pages` of each at most, or all.

    Transient errors are retried with growing pauses, a rate limit is waited out. Every row says whether more pages
    follow, so a reader that stops early is seen to have done so.
    """

    def __init__(self, queries: list[tuple], client: Client, max_pages: int | None = None, retries: int = 5, pause_s: float = 1.0, sleep=time.sleep, clock=time.time):
        self.queries, self.client, self.max_pages, self.retries, self.pause_s, self.sleep, self.clock = queries, client, max_pages, retries, pause_s, sleep, clock

    def partitions(self) -> list[InputPartition]:
        return [_Partition(*q) for q in self.queries]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        cursor, page_no = partition.cursor, partition.page_no
        while self.max_pages is None or page_no < partition.page_no + self.max_pages:
            page = self._get(partition.query, cursor)
            info = page.get("pageInfo") or {}
            cursor, more = info.get("endCursor"), bool(info.get("hasNextPage"))
            yield partition.label, partition.query, page_no, json.dumps(page), cursor, more
            page_no += 1
            if not more:
                return

    def _get(self, query: str, cursor: str | None) -> dict:
        for attempt in range(self.retries + 1):
            try:
                return self.client(query, cursor)
            except RateLimited as e:
                if attempt == self.retries:
                    raise
                self.sleep(max(0.0, e.reset_at - self.clock()) + self.pause_s)
            except (ConnectionError, TimeoutError):
                if attempt == self.retries:
                    raise
                self.sleep(self.pause_s * 2**attempt)
        raise AssertionError


def page_source(name: str, queries: list[tuple], client: Client, **options) -> type[DataSource]:
    """A data source class for `spark.dataSource.register`: columns label, query, page_no, page (JSON), end_cursor, has_next.

    A query is (label, text), or (label, text, cursor, page number) to go on from.
    """

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> PageReader:
            return PageReader(queries, client, **options)

    return PageSource


def page_state(pages: DataFrame) -> DataFrame:
    """label, query, end_cursor, has_next, next_page of each query's last stored page."""
    last = F.max_by(F.struct("query", "end_cursor", "has_next", (F.col("page_no") + 1).alias("next_page")), "page_no")
    return pages.groupBy("label").agg(last.alias("s")).select("label", "s.*")


def resume_plan(queries: list[tuple[str, str]], state: dict[str, tuple]) -> tuple[list[tuple], list[str]]:
    """(queries to read with their cursor and page number, labels whose stored pages are stale)."""
    todo, stale = [], []
    for label, query in queries:
        old, cursor, more, page_no = state.get(label, (query, None, True, 0))
        if old != query:
            stale.append(label)
            todo.append((label, query, None, 0))
        elif more:
            todo.append((label, query, cursor, page_no))
    return todo, stale


def collect_pages(spark: SparkSession, queries: list[tuple[str, str]], client: Client, path: str, pages_per_round: int = 10, **options) -> DataFrame:
    """All pages of the queries, kept under `path`; each round reads at most `pages_per_round` pages a query and stores them.

    A crash costs the pages of one round. The list of queries is configuration, so its state (one row a label) is small.
    """
    schema = PAGE
    labels = [label for label, _ in queries]
    while True:
        stored = spark.createDataFrame([], schema)
        try:
            stored = spark.read.schema(schema).parquet(path)
        except Exception as e:  # noqa: BLE001 - a path that is not there yet is an empty store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        stored = stored.where(F.col("label").isin(labels))
        state = {r.label: (r.query, r.end_cursor, r.has_next, r.next_page) for r in page_state(stored).collect()}
        todo, stale = resume_plan(queries, state)
        if not todo:
            return stored.select(*[c.split()[0] for c in schema.split(", ")])
        name = f"pages_{abs(hash((path, len(state), sum(q[3] for q in todo))))}"
        spark.dataSource.register(page_source(name, todo, client, max_pages=pages_per_round, **options))
        new = spark.read.format(name).load()
        if stale:  # a new text replaces the partition of its label
            new.where(F.col("label").isin(stale)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(path)
        new.where(~F.col("label").isin(stale)).write.mode("append").partitionBy("label").parquet(path)


def code_search_client(fetch: Callable[[str, int, int], dict], per_page: int = 100, cap: int = 1000, gap_s: float = 6.5, sleep=time.sleep, clock=time.monotonic) -> Client:
    """A client over a numbered code search: `fetch(query, page, per_page)` gives total_count, incomplete_results and items.

    The service shows `cap` results of a query at most; a page says so in `truncated`. Calls are `gap_s` apart.
    """
    last = [-1e9]

    def client(query: str, cursor: str | None) -> dict:
        page = int(cursor or 1)
        wait = last[0] + gap_s - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        got = trim_code_page(fetch(query, page, per_page))
        total = got["total_count"] or 0
        more = page * per_page < min(total, cap) and bool(got["items"])
        return got | {"truncated": total > cap, "pageInfo": {"hasNextPage": more, "endCursor": str(page + 1)}}

    return client


#: The fields of a code hit that are kept.
_REPO_FIELDS, _OWNER_FIELDS = ["id", "node_id", "name", "full_name", "private", "html_url", "description", "fork"], ["id", "node_id", "login"]


def trim_code_page(page: dict) -> dict:
    """A code search page without what nothing reads."""
    items = [i for i in page.get("items") or [] if i.get("repository")]
    keep = lambda d, names: {k: d.get(k) for k in names}
    return {"total_count": page.get("total_count"), "incomplete_results": page.get("incomplete_results"), "items": [{"score": i.get("score"), "repository": keep(i["repository"], _REPO_FIELDS) | {"owner": keep(i["repository"].get("owner") or {}, _OWNER_FIELDS)}} for i in items]}


def trim_code_pages(pages: DataFrame) -> DataFrame:
    """The same for a table of pages: nested pruning, so a columnar scan reads no other field; hits without a repository go."""
    items = F.transform(F.filter("items", lambda i: i["repository"].isNotNull()), lambda i: F.struct(i["score"].alias("score"), F.struct(*(i["repository"][k].alias(k) for k in ("full_name", "fork", "description"))).alias("repository")))
    return pages.select("label", "seq", "total_count", "incomplete_results", items.alias("items"))


def hydrate(hits: DataFrame, cache: DataFrame, client: Callable[[str], dict | None]) -> tuple[DataFrame, DataFrame]:
    """(name_with_owner, body, error) of hits: from the cache (name_with_owner, body), else through the client; and of those not found.

    A repository that no longer exists is set apart with its reason; any other error fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, bodies, errors = b.column("name_with_owner").to_pylist(), [], []
            for n in names:
                try:
                    got = client(n)
                except NotFound:
                    got = None
                bodies.append(None if got is None else json.dumps(got))
                errors.append("NOT_FOUND" if got is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=["name_with_owner", "body", "error"])

    names = hits.select("name_with_owner").where("name_with_owner is not null").distinct()
    known = names.join(cache.select("name_with_owner", "body"), "name_with_owner")
    fetched = names.join(cache.select("name_with_owner"), "name_with_owner", "left_anti").mapInArrow(run, "name_with_owner string, body string, error string")
    rows = known.withColumn("error", F.lit(None).cast("string")).unionByName(fetched)
    return rows.where("error is null"), rows.where("error is not null")
