"""Running judges over pending work through an injected scorer.

A scorer is a callable from a list of payloads to a list of replies (JSON text); it runs once per Arrow batch in each
partition, and partitions are shards of the work by the key's hash, so one shard can hold one credential. Replies are
validated against the rubric (six components, scores 1 to 5) and become ok rows or error rows; nothing is dropped.
"""

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import shard_for
from .facts import COMPONENTS

Scorer = Callable[[list[dict]], list[str]]
REGISTRY: dict[str, Callable[..., Scorer]] = {}

#: What providers' error texts mean.
ERROR_KINDS = [("refusal", ("content policy", "refuse", "safety")), ("quota", ("quota", "exceeded")), ("balance", ("balance", "billing", "payment")), ("rate_limit", ("rate limit", "429", "too many requests"))]


def register(provider: str):
    def add(f):
        REGISTRY[provider] = f
        return f

    return add


def build_scorer(provider: str, **options) -> Scorer:
    if provider not in REGISTRY:
        raise KeyError(f"no scorer for provider {provider!r}")
    return REGISTRY[provider](**options)


class RateLimiter:
    """Even pacing of calls in one partition."""

    def __init__(self, per_minute: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = (60.0 / per_minute if per_minute else 0.0), clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def payloads(tools: DataFrame, limit: int = 32_000) -> DataFrame:
    """tool_uid, name, server_name, description and the source text (null without one), cut with a notice when long."""
    from ..functions.keys import truncate_with_notice

    source = F.col("source_code") if "source_code" in tools.columns else F.lit(None).cast("string")
    return tools.select("tool_uid", F.col("tool.name").alias("name"), F.col("repo.name_with_owner").alias("server_name"), F.col("tool.description").alias("description"), truncate_with_notice(source, limit).alias("source_code"))


def error_kind(detail):
    """Column: the kind of an error text, 'other' where none fits."""
    t = F.lower(F.coalesce(detail, F.lit("")))
    out = F.lit("other")
    for kind, words in reversed(ERROR_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def parse_reply(text: str | None) -> tuple[str, dict | None, str | None]:
    """(status, scores, error) of a reply: the first JSON object in it must hold six valid scores."""
    if text is None:
        return "error", None, "no reply"
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a:
        return "error", None, "no JSON object"
    try:
        obj = json.loads(text[a : b + 1])
    except ValueError as e:
        return "error", None, f"invalid JSON: {e}"
    if obj.get("refused") is True:
        return "refused", None, None
    scores = {}
    for c in COMPONENTS:
        v = obj.get(c)
        s = v.get("score") if isinstance(v, dict) else None
        if isinstance(s, bool) or not isinstance(s, int) or not 1 <= s <= 5:
            return "error", None, f"invalid score of {c}"
        scores[c] = {"score": s, "reasoning": v.get("reasoning")}
    return "ok", scores, None


def _call(scorer: Scorer, rows: list[dict], limiter: RateLimiter) -> list[tuple[str, dict | None, str | None]]:
    limiter.wait()
    try:
        replies = scorer(rows)
    except Exception as e:  # noqa: BLE001 - a scorer's failure is a result, not a crash of the job
        return [("error", None, str(e))] * len(rows)
    return [parse_reply(r) for r in replies] if len(replies) == len(rows) else [("error", None, "scorer gave a wrong number of replies")] * len(rows)


def run_judge(work: DataFrame, judge_id: str, scorer: Scorer, shards: int = 4, per_minute: float | None = None, rows_per_call: int = 1) -> DataFrame:
    """Evaluated rows: tool_uid, scenario, judge, status, scores (struct) and error_detail for each row of work.

    The scorer is called for `rows_per_call` rows at a time; each call waits for its turn, and a failure is the error of its
    rows alone. Each of the `shards` tasks has a limiter of its own, as it has a credential of its own.
    """
    cell = pa.struct([("score", pa.int32()), ("reasoning", pa.string())])
    kind = pa.struct([(c, cell) for c in COMPONENTS])
    schema = "tool_uid string, scenario string, judge string, status string, scores struct<" + ",".join(f"{c}:struct<score:int,reasoning:string>" for c in COMPONENTS) + ">, error_detail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = RateLimiter(per_minute)
        for b in batches:
            rows = b.to_pylist()
            if not rows:
                continue
            parsed = [p for a in range(0, len(rows), rows_per_call) for p in _call(scorer, rows[a : a + rows_per_call], limiter)]
            yield pa.RecordBatch.from_arrays(
                [b.column("tool_uid"), b.column("scenario"), pa.array([judge_id] * len(rows)), pa.array([p[0] for p in parsed]), pa.array([p[1] for p in parsed], kind), pa.array([p[2] for p in parsed], pa.string())],
                names=["tool_uid", "scenario", "judge", "status", "scores", "error_detail"],
            )

    return work.repartition(shards, shard_for(F.col("tool_uid"), 1 << 20)).mapInArrow(run, schema)


def closed_set_labels(labels: DataFrame, allowed: list[str], column: str = "categories") -> DataFrame:
    """Labels outside the closed set are dropped; rows left without one get 'none'."""
    kept = F.array_intersect(F.col(column), F.array(*(F.lit(a) for a in allowed)))
    return labels.withColumn(column, F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("none"))))


def reconcile_labels(a: DataFrame, b: DataFrame, key: str, column: str = "categories") -> DataFrame:
    """Labels on which both lists agree; where they share none, all of either."""
    rows = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key, "full")
    e = F.array().cast("array<string>")
    x, y = F.coalesce("x", e), F.coalesce("y", e)
    both = F.array_intersect(x, y)
    return rows.select(key, F.when(F.size(both) > 0, both).otherwise(F.array_union(x, y)).alias(column))


@register("fixed")
def fixed_scorer(score: int = 3) -> Scorer:
    """A deterministic scorer for tests and dry runs."""

    def scorer(rows: list[dict]) -> list[str]:
        return [json.dumps({c: {"score": score, "reasoning": f"{r.get('name') or r['tool_uid']}: {c}"} for c in COMPONENTS}) for r in rows]

    return scorer


class QuotaExhausted(Exception):
    """Raised by a transport whose credential has no quota left."""


#: Replies of a service that are worth another try.
RETRIED = (408, 409, 429, 500, 502, 503, 504)


def rotating(keys: list[str], call: Callable[[str, dict], dict]) -> Callable[[dict], dict]:
    """A call that goes on with the next credential when one is exhausted; without any left it raises."""
    left = list(keys)

    def run(request: dict) -> dict:
        while left:
            try:
                return call(left[0], request)
            except QuotaExhausted:
                left.pop(0)
        raise QuotaExhausted("no credential has quota left")

    return run


def quota_detail(text: str) -> dict[str, str]:
    """metric, limit and retry_s of a service's JSON error text about quotas, where it names them."""
    try:
        error = json.loads(text[text.index("{") :]).get("error", {})
    except (ValueError, AttributeError):
        return {}
    out = {}
    for d in error.get("details", []) if isinstance(error, dict) else []:
        for v in d.get("violations", []):
            out |= {k: str(v[f]) for k, f in (("metric", "quotaMetric"), ("limit", "quotaValue")) if f in v}
        if "retryDelay" in d:
            out["retry_s"] = str(d["retryDelay"]).rstrip("s")
    return out


@register("chat")
def chat_scorer(transport: Callable[[str, dict], tuple[int, dict]], model: str, keys: list[str], instruction: str, retries: int = 4, pause_s: float = 1.0, sleep=time.sleep) -> Scorer:
    """A scorer over a chat completion service.

    `transport(key, request)` sends a request and gives (HTTP status, reply); it is injected, so no network is needed to
    test it. Transient replies are retried with growing pauses, a credential without quota is replaced by the next.
    """

    def call(key: str, request: dict) -> dict:
        for attempt in range(retries + 1):
            status, reply = transport(key, request)
            if status == 200:
                return reply
            text = json.dumps(reply)
            if status == 429 and "quota" in text.lower():
                raise QuotaExhausted(text)
            if status not in RETRIED or attempt == retries:
                raise RuntimeError(f"{status}: {text}")
            sleep(pause_s * 2**attempt)
        raise AssertionError

    send = rotating(keys, call)

    def scorer(rows: list[dict]) -> list[str]:
        out = []
        for r in rows:
            shown = {k: r.get(k) for k in ("name", "server_name", "description", "source_code") if r.get(k) is not None}
            reply = send({"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": json.dumps(shown, ensure_ascii=False)}]})
            choice = (reply.get("choices") or [{}])[0]
            refused = choice.get("message", {}).get("refusal") or choice.get("finish_reason") == "content_filter"
            out.append(json.dumps({"refused": True}) if refused else choice.get("message", {}).get("content"))
        return out

    return scorer
