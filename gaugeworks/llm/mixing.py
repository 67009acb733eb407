"""Mixing sources to target token shares by entropy balancing.

The base measure gives each document its tokens; the constraints fix the share of tokens of each source. The dual of the
minimum-entropy tilt, log sum_i t_i exp(lambda_s(i)) - sum_s share_s lambda_s, is convex; each Newton step takes one
distributed aggregation of the tilted token sums per source. The rates exp(lambda) are then scaled to the largest total
for which no rate exceeds its source's cap (or to a given total), and rounded: every document gets floor(rate) copies,
and the documents whose hash is below a threshold of their source one more. The threshold comes from a histogram of
tokens by hash, refined inside the bin it falls in (found on the cluster), so the tokens of a source are met to within one document (or one group of
equal hashes) at any size, without sorting a source in one task.

Only one row per source that has a target reaches the driver (the targets are the query's small parameter table, checked
against MAX_SOURCES); documents are never collected.

Defined results: source names match without case and surrounding blanks; null and unnamed sources, and sources without a
target, get no copies; targets without any text are reported with a share of 0, and the others share what is left in
proportion; null and empty texts have 0 tokens and get no copies; repeated documents count each; an empty table selects
nothing.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SOURCES = 10_000
BINS = 4096
VOCABULARY = "byte_bpe_50k.json"


def source_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source_name, tokens: exact token counts of whole texts.

    `vocabulary` is the path of a tokenizers file; without it the installed public one is used where the task runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        tok = Tokenizer.from_file(str(path))
        tok.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            own = list(dict.fromkeys(texts))  # repeated texts of a batch are counted once
            counts: dict[str, int] = {}
            for a in range(0, len(own), 256):
                counts.update(zip(own[a : a + 256], (len(e.ids) for e in tok.encode_batch(own[a : a + 256], add_special_tokens=False))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source_name"), pa.array([counts[t] for t in texts], pa.int64())], names=["doc_id", "source_name", "tokens"])

    return documents.select("doc_id", source_name(F.col("source")).alias("source_name"), "text").mapInArrow(run, "doc_id long, source_name string, tokens long")


def _tilted(counts: DataFrame, tilt: dict[str, float]) -> dict[str, float]:
    """Token sum of each source with a target, tilted by exp(lambda) (one distributed aggregation)."""
    m = F.create_map(*(x for k, v in tilt.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = counts.where(F.col("source_name").isin(list(tilt))).groupBy("source_name").agg(F.sum(F.col("tokens") * F.exp(F.element_at(m, F.col("source_name")))).alias("z")).collect()
    return {r.source_name: float(r.z) for r in rows}


def solve_rates(counts: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, max_steps: int = 50, tolerance: float = 1e-12) -> tuple[dict[str, float], dict[str, float]]:
    """(copies per document of each source, tokens of each source).

    Newton's iteration on the dual with a step bound; the Hessian diag(q) - q q' is inverted up to the constant along
    which the dual is flat. Without `total`, the total is the largest that all caps allow.
    """
    tokens = _tilted(counts, dict.fromkeys(targets, 0.0)) if targets else {}
    names = [s for s in sorted(targets) if tokens.get(s, 0) > 0 and targets[s][0] > 0 and targets[s][1] > 0]
    if not names:
        return {}, tokens
    share = np.array([targets[s][0] for s in names])
    share /= share.sum()
    lam = np.zeros(len(names))
    z = np.array([tokens[s] for s in names])
    for _ in range(max_steps):
        q = z / z.sum()
        gap = q - share
        if np.abs(gap).max() < tolerance:
            break
        step = np.linalg.lstsq(np.diag(q) - np.outer(q, q), gap, rcond=None)[0]
        lam -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        got = _tilted(counts, dict(zip(names, lam)))
        z = np.array([got[s] for s in names])
    rate = np.exp(lam - lam.max())
    cap = np.array([targets[s][1] for s in names], float)
    scale = (cap / rate).min() if total is None else total / float((rate * [tokens[s] for s in names]).sum())
    return dict(zip(names, np.minimum(rate * scale, cap).tolist())), tokens


def _position() -> Column:
    """A document's place in [0, 2^48) of its source, the same on every run."""
    return F.xxhash64("doc_id", F.lit(20_240)).bitwiseAND((1 << 48) - 1)


def _thresholds(counts: DataFrame, wanted: dict[str, float]) -> dict[str, int]:
    """The hash threshold of each source below which documents hold about the wanted tokens: a histogram, refined to single hashes."""
    low, width, left, done = dict.fromkeys(wanted, 0), 1 << 48, dict(wanted), {}
    while width > 1 and left:
        width //= BINS
        m = F.create_map(*(x for k in left for x in (F.lit(k), F.lit(low[k]))))
        own = counts.where(F.col("source_name").isin(list(left))).withColumn("bin", F.floor((_position() - F.element_at(m, F.col("source_name"))) / F.lit(width)).cast("long"))
        hist = own.where(F.col("bin").between(0, BINS - 1)).groupBy("source_name", "bin").agg(F.sum("tokens").alias("tokens"))
        # The bin in which a source's tokens pass what is wanted: found over at most BINS rows a source, one row a source returns.
        wanted_now = F.create_map(*(x for k, v in left.items() for x in (F.lit(k), F.lit(float(v)))))
        upto = hist.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source_name").orderBy("bin")))
        rows = upto.where(F.col("upto") > F.element_at(wanted_now, F.col("source_name"))).groupBy("source_name").agg(F.min(F.struct("bin", "upto", "tokens")).alias("b")).select("source_name", "b.*").collect()
        crossed = {r.source_name: r for r in rows}
        for s in list(left):
            r = crossed.get(s)
            if r is None:
                done[s] = low[s] + BINS * width
            else:
                low[s] += r.bin * width
                left[s] -= r.upto - r.tokens
                if width == 1:
                    done[s] = low[s] + (1 if left[s] > r.tokens / 2 else 0)
            if s in done:
                left.pop(s)
    return done | {s: low[s] for s in left}


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix_targets.where("source_name is not null and target_share is not null").groupBy(source_name(F.col("source_name")).alias("s")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    return {r.s: (r.share, r.cap) for r in rows}


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, tuple[float, int]]]:
    """(selection: doc_id, source_name, tokens, copies; token counts, persisted; targets by source)."""
    targets = _targets(mix_targets)
    counts = token_counts(documents, vocabulary).persist(StorageLevel.MEMORY_AND_DISK)
    rates, tokens = solve_rates(counts, targets, total)
    whole = {s: int(r + 1e-9) for s, r in rates.items()}
    wanted = {s: (r - whole[s]) * tokens[s] for s, r in rates.items() if r - whole[s] > 1e-9}
    limits = _thresholds(counts, wanted)
    if not rates:
        return counts.where("false").withColumn("copies", F.lit(0)), counts, targets
    base = F.create_map(*(x for s, n in whole.items() for x in (F.lit(s), F.lit(n))))
    more = F.create_map(*(x for s in whole for x in (F.lit(s), F.lit(limits.get(s, 0)))))
    s = F.col("source_name")
    copies = (F.element_at(base, s) + F.when(_position() < F.element_at(more, s), 1).otherwise(0)).cast("int")
    selected = counts.where(s.isin(list(rates)) & (F.col("tokens") > 0)).withColumn("copies", copies).where("copies > 0")
    return selected, counts, targets


def share_report(selected: DataFrame, counts: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per source with a target: target_share, tokens, selected_tokens, actual_share, max_copies, n_documents."""
    have = counts.groupBy("source_name").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_documents"))
    got = selected.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.max("copies").alias("max_copies"))
    total = got.select(F.sum("selected_tokens").alias("n")).scalar()
    wanted = mix_targets.groupBy(source_name(F.col("source_name")).alias("source_name")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return wanted.join(have, "source_name", "left").join(got, "source_name", "left").select(
        "source_name", "target_share", "max_repeats",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"),
        F.coalesce(F.try_divide(F.col("selected_tokens"), total), F.lit(0.0)).alias("actual_share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
