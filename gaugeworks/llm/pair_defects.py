"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and pair features.

Prompt is a tool's description, response the judge's reasoning. One logistic model per defect (empty, truncated, refusal,
copy, foreign) over hashed n-grams of the response, n-grams anchored at its end, the start of its last sentence joined
with its length and last word, n-grams of word classes, and dense pair features (how much of the response stands in the
description, and the reverse). Training rows are made from a bounded sample of real pairs (about SAMPLE_ROWS, by a
threshold on the hash of the id, whole texts) by defect: responses cut off, with or without a mark; descriptions copied
whole, in part, quoted or twice; responses swapped between rows (sound ones, so that a copy must be of the row's own
description); refusals of a grammar, foreign statements of each language's common words and void texts (pair_grammar,
which is general language and knows no table). Thresholds are calibrated per defect on held-out rows.

Whether a statement without a full stop is complete depends on the texts at hand, so two statistics are counted over all
rows (never a sample): how often each sentence opening ends without a full stop, and how often each pair of last words
ends a sentence with a full stop among all its uses. They are kept by 64-bit key in a distributed table of any size;
only responses without a full stop look up the two keys of their end, through narrow joins.

Defined results: only rows with status ok are judged; a null reasoning, or one without any letter or digit, is empty; a
row gets the likeliest of its defects, of equal ones the first in order; a null description is empty text, so nothing
counts as its copy; repeated rows are judged each; an empty table gives no rows.
"""

import functools
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import hashing
from .pair_grammar import CLASSES, FUNCTION_WORDS, LANGUAGES, REFUSALS, SOUND, WORDS, expand, foreign, void
from .text import plain

DEFECTS = ["empty", "copy", "refusal", "foreign", "truncated"]
#: Pairs that training rows are made of.
SAMPLE_ROWS = 3000
#: Sampled rows that a general model holds defective with more than this probability are not taken for sound.
DOUBT = 0.3
#: Keys a task counts before it passes its counts on.
COUNTED = 200_000

_CODE = re.compile(r"`[^`\n]*`?")
_NAME = re.compile(r"`[^`\n]*`|[A-Za-z0-9]*_\w*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|`")
_STOP = re.compile(r"[.!?。！？…]+[\"'”’)\]]*\s+")
_CLOSED = re.compile(r"(?:[.!?][\"'”’)\]`]*|[。！？][”」』]?)$")
_MARK = re.compile(r"\s*(?:\.\.\.|…|\[[^\]\w]*(?:\.\.\.|…|cut|truncated|snip)?[^\]\w]*\]|<(?:cut|snip|truncated|eos|end)>|\((?:cut|truncated|continued)\)|[-–—]+|/{2,}|\[(?:cut|truncated|snip)\])$", re.I)


#: A stop behind a letter, a digit or a closing sign: no mark of an omission, whatever else the text holds.
_PLAINLY_CLOSED = r"[\p{L}\p{N}`\"')][.!?]\s*$"


def is_closed(text: str) -> bool:
    """Whether a text ends with a full stop (or its like) that is no mark of an omission."""
    return bool(_CLOSED.search(text)) and not _MARK.search(text)


def words(text: str) -> list[str]:
    """Words in lower case; numbers and code become one mark each, words with an apostrophe stay whole."""
    return ["0" if w.isdigit() else w for w in _WORD.findall(_CODE.sub(" ` ", text).lower())]


def sentences(text: str) -> list[str]:
    return [p for p in _STOP.split(text) if p.strip()]


def _opening(ws: list[str]) -> str:
    """The first three words of a sentence, fewer where it has no word beyond them."""
    return " ".join(ws[: min(3, len(ws) - 1)])


def _key(kind: str, s: str) -> int:
    """64 signed bits."""
    h = xxhash.xxh64_intdigest(kind + s)
    return h - (1 << 64) if h >> 63 else h


def end_keys(text: str | None) -> tuple[int, int] | None:
    """Keys of the last pair of words and of the opening of the last sentence, of a text without a full stop."""
    t = plain(text or "").strip()
    if not t or is_closed(t):
        return None
    parts = sentences(t)
    ws, last = words(t), words(parts[-1]) if parts else []
    if not last:
        return None
    return _key("e", " ".join(ws[-2:]) if len(last) > 1 else " " + last[0]), _key("o", _opening(last))


@dataclass(frozen=True)
class Endings:
    """For each key (hits, uses): an opening's sentences last without a stop and last at all; a pair's places before a stop and anywhere."""

    counts: dict[int, tuple[int, int]]

    def rates(self, text: str | None) -> tuple[float, float]:
        keys = end_keys(text)
        return (_end_rate(*self.counts.get(keys[0], (0, 0))), _bare_rate(*self.counts.get(keys[1], (0, 0)))) if keys else (0.0, 0.0)


def _end_rate(hits: int, uses: int) -> float:
    return (hits + 0.02) / (uses + 1.0)


def _bare_rate(hits: int, uses: int) -> float:
    return (hits + 0.1) / (uses + 1.0)


def _count(text: str | None, counts: dict[int, list[int]]) -> None:
    if not text or not text.strip():
        return
    t = plain(text).strip()
    parts = sentences(t)
    whole = is_closed(t)
    for k, p in enumerate(parts):
        ws = words(p)
        if not ws:
            continue
        last = k == len(parts) - 1
        end = not last or whole
        for i, (a, b) in enumerate(zip(["", *ws], ws)):
            c = counts.setdefault(_key("e", a + " " + b), [0, 0])
            c[0] += end and i == len(ws) - 1
            c[1] += 1
        if last:
            for n in range(min(4, len(ws))):
                c = counts.setdefault(_key("o", " ".join(ws[:n])), [0, 0])
                c[0] += not whole
                c[1] += 1


def count_endings(responses: DataFrame) -> DataFrame:
    """key, hits, uses over all responses: each task adds up its own counts first, so a frequent key costs it one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array((c[0] for c in counts.values()), pa.int64()), pa.array((c[1] for c in counts.values()), pa.int64())], names=["key", "hits", "uses"])

        for b in batches:
            for t in b.column("reasoning").to_pylist():
                _count(t, counts)
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return responses.select("reasoning").mapInArrow(run, "key long, hits long, uses long").groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("uses").alias("uses"))


def with_rates(pairs: DataFrame, endings: DataFrame) -> DataFrame:
    """The pairs with end_rate and bare_rate, null for responses with a full stop.

    Responses that plainly end in a full stop pass by. Of the others only ids, text hashes and keys are joined to the
    counts; the result, again narrow and with one row per id and text, meets the pairs on the id, so no text follows a
    frequent ending.
    """
    plainly = F.coalesce(F.col("reasoning").rlike(_PLAINLY_CLOSED), F.lit(True))
    closed, pairs = pairs.where(plainly), pairs.where(~plainly)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, *k) for i, h, t in zip(b.column("eval_id").to_pylist(), b.column("__gw_text").to_pylist(), b.column("reasoning").to_pylist()) if (k := end_keys(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["eval_id", "__gw_text", "pair", "opening"])

    own = pairs.withColumn("__gw_text", F.xxhash64("reasoning"))
    keys = own.select("eval_id", "__gw_text", "reasoning").mapInArrow(run, "eval_id long, __gw_text long, pair long, opening long").distinct()
    e = endings.select(F.col("key").alias("pair"), ((F.col("hits") + 0.02) / (F.col("uses") + 1.0)).alias("end_rate"))
    o = endings.select(F.col("key").alias("opening"), ((F.col("hits") + 0.1) / (F.col("uses") + 1.0)).alias("bare_rate"))
    rates = keys.join(e, "pair", "left").join(o, "opening", "left").select("eval_id", "__gw_text", "end_rate", "bare_rate")
    none = F.lit(None).cast("double")
    return closed.withColumn("end_rate", none).withColumn("bare_rate", none).unionByName(own.join(rates, ["eval_id", "__gw_text"], "left").drop("__gw_text"))


@functools.lru_cache(maxsize=4096)
def _prompt(description: str) -> tuple[frozenset, list, frozenset]:
    """(words, word triples in order, set of triples) of a description; many rows share one."""
    ws = words(plain(description))
    triples = list(zip(ws, ws[1:], ws[2:]))
    return frozenset(ws), triples, frozenset(triples)


def _bare(w: str) -> str:
    """Without accents."""
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


_WHOLE = {w: k for k, kind in enumerate(CLASSES[1:], 1) for w in WORDS[kind].split() if not w.endswith("*")}
_BEGIN = {w[:-1]: k for k, kind in enumerate(CLASSES[1:], 1) for w in WORDS[kind].split() if w.endswith("*")}


@functools.lru_cache(maxsize=1 << 16)
def _class(w: str) -> int:
    w = w.replace("’", "'")
    return _WHOLE.get(w) or next((_BEGIN[w[:n]] for n in range(len(w), 3, -1) if w[:n] in _BEGIN), 0)


#: Words of other languages that are none of English, with the languages they belong to.
_FOREIGN_WORDS: dict[str, tuple[str, ...]] = {}
for _k, _ws in FUNCTION_WORDS.items():
    for _w in {x for w in _ws for x in (w, _bare(w))} - FUNCTION_WORDS["en"]:
        _FOREIGN_WORDS[_w] = (*_FOREIGN_WORDS.get(_w, ()), _k)


_EXTRA = 18
#: Dense features are scaled up against the many hashed ones, so that they are learnt first.
_SCALE = 4.0


def _dense(text: str, ws: list[str], description: str, end: float, bare: float) -> list[float]:
    bare_text = _NAME.sub("", text)
    n_letters = sum(map(str.isalpha, bare_text))
    n = max(1, n_letters)
    latin, beyond = 1.0 if n_letters else 0.0, 0.0
    if not bare_text.isascii():
        latin = sum(c.isascii() and c.isalpha() for c in bare_text) / n
        beyond = sum(c > "\u024f" and c.isalpha() for c in bare_text) / n
    count = max(1, len(ws))
    own = [w for w in ws if w != "`" and w != "0"]
    english = sum(map(FUNCTION_WORDS["en"].__contains__, own))
    others = Counter(k for w in own if w in _FOREIGN_WORDS for k in _FOREIGN_WORDS[w])
    other = max(others.values(), default=0)
    m = max(1, len(own))
    stripped = text.rstrip()
    closed = is_closed(stripped)
    known, triples, triple_set = _prompt(description)
    mine = list(zip(ws, ws[1:], ws[2:]))
    contained = sum(map(triple_set.__contains__, mine)) / len(mine) if mine else 0.0
    mine_set = set(mine)
    covered = sum(map(mine_set.__contains__, triples)) / len(triples) if triples and mine else 0.0
    return [
        float(not n_letters), 1.0 - latin, beyond, float(beyond > 0.3), english / m, other / m, float(english == 0 and m > 3),
        contained, covered, contained * covered, float(contained > 0.8 and covered > 0.5), sum(map(known.__contains__, ws)) / count,
        float(closed), 0.0 if closed else end, 0.0 if closed else bare, float(not closed and end < 0.05), float(bool(_MARK.search(stripped)) and not closed), min(3.0, np.log1p(count) / 2),
    ]


def features(pairs: list[tuple[str, str]], rates: list[tuple[float, float]]) -> hashing.Rows:
    """Rows of (response, description) pairs with the (end, bare) rates of their endings."""
    texts = [plain(r or "").strip() for r, _ in pairs]
    ws = [words(t) for t in texts]
    dense = np.array([_dense(t, w, d or "", *e) for t, w, (_, d), e in zip(texts, ws, pairs, rates)], np.float32).reshape(-1, _EXTRA) * np.float32(_SCALE)
    tail, shape = [], []
    for t, w in zip(texts, ws):
        parts = sentences(t)
        last = words(parts[-1]) if parts else []
        open_end = "" if is_closed(t) else "|open"
        head = _opening(last)
        tail.append([f"{' '.join(w[-k:])}{open_end}$" for k in (1, 2, 3)])
        shape.append([f"{head}#{min(len(last), 30)}{open_end}", f"{head}#{last[-1] if last else ''}{open_end}", f"{' '.join(last[:2])}#{' '.join(last[-2:])}{open_end}"])
    lowered = [t.lower() for t in texts]
    x = hashing.assemble(len(pairs), [
        hashing.char_grams(lowered, (4,)), hashing.word_grams(ws, (1,), 5), hashing.word_grams(ws, (2,), 6),
        hashing.char_grams([t[-12:] for t in lowered], (2, 3), 7), hashing.word_grams(tail, (1,), 8), hashing.word_grams(shape, (1,), 9),
        hashing.class_grams([[_class(w) for w in own] for own in ws], len(CLASSES)),
    ], dense)
    x.value[len(x.value) - x.last :] *= np.float32(_SCALE / 2)
    return x


@dataclass
class Detector:
    models: list[hashing.Linear]
    thresholds: list[float]

    def defects(self, pairs: list[tuple[str | None, str | None]], rates: list[tuple[float, float]]) -> list[str | None]:
        """The defect of each pair, or None."""
        x = features([(r or "", d or "") for r, d in pairs], rates)
        z = np.stack([m.logit(x) - np.log(t / (1 - t)) for m, t in zip(self.models, self.thresholds)], axis=1)
        best = z.argmax(axis=1)
        return ["empty" if not any(c.isalnum() for c in (r or "")) else DEFECTS[b] if z[i, b] >= 0 else None for i, ((r, _), b) in enumerate(zip(pairs, best))]


def _cut(text: str, rng: random.Random) -> str | None:
    """The text broken off inside a sentence, at a word or within one."""
    parts = [m.end() for m in _STOP.finditer(text)]
    starts = [0, *parts]
    a = rng.choice(starts)
    b = next((p for p in parts if p > a), len(text))
    body = text[a:b].rstrip(" .!?")
    if len(body) < 12:
        return None
    k = rng.randrange(4, len(body) - 3)
    if rng.random() < 0.6 and " " in body[1:k]:
        k = body.rindex(" ", 1, k)
    out = text[:a] + body[:k].rstrip()
    if not out.strip() or out.rstrip()[-1] in ".!?":
        return None
    return out + (rng.choice(["...", " ...", "…", " [...]", " <cut>", " -", " —", " [truncated]"]) if rng.random() < 0.25 else "")


def _copy(description: str, rng: random.Random) -> str | None:
    ws = description.split()
    if len(ws) < 4:
        return None
    kind = rng.randrange(7)
    flat = " ".join(ws)
    if kind == 0:
        return description
    if kind == 1:
        return flat
    if kind == 2:
        return '"' + flat + '"'
    if kind == 3:
        return f"{rng.choice(['Description', 'Tool description', 'The description', 'Text'])}: {flat}"
    if kind == 4:
        return flat + " " + flat
    if kind == 5:
        return " ".join(ws[: max(3, int(len(ws) * rng.uniform(0.58, 0.97)))])
    return rng.choice([flat.lower(), flat.rstrip("."), " ".join(ws[max(0, len(ws) // 8) :])])


def _training_rows(sample: list[tuple[str, str]], endings: Endings, rng: random.Random):
    """(pairs, rates, labels): sound rows of the sample and defects made of them."""
    things = sorted({m for r, _ in sample for m in re.findall(r"`(\w+)`", r)}) or ["load_item"]
    topics = sorted({" ".join(ws[a : a + 2]) for _, d in sample[:800] for ws in (words(d),) if len(ws) > 4 for a in (rng.randrange(len(ws) - 1),)}) or ["other things"]
    rows: list[tuple[str, str]] = []
    labels: list[str | None] = []

    def add(r: str | None, d: str, label: str | None) -> None:
        if r is not None:
            rows.append((r, d))
            labels.append(label)

    def looks_sound(r: str, d: str) -> bool:
        f = _dense(plain(r).strip(), words(plain(r)), d, *endings.rates(r))
        return not f[0] and f[7] < 0.6 and (f[4] > 0.08 or len(r) < 40) and f[2] < 0.2 and (bool(f[12]) or f[14] > 0.5) and not f[16]

    sound = [(r, d) for r, d in sample if r and looks_sound(r, d)]
    for r, d in sound:
        add(r, d, None)
    for r, d in sound:
        if is_closed(r):
            add(_cut(r, rng), d, "truncated")
            if rng.random() < 0.05:
                add(r.rstrip().rstrip(".!?"), d, None)  # complete without a full stop
        if rng.random() < 0.2 and len(sound) > 1:
            add(r, rng.choice(sound)[1], None)  # swapped prompt
        if rng.random() < 0.35:
            copied = _copy(d, rng)
            add(copied, d, "copy")
            other = rng.choice(sound)[1]
            if copied and other != d:  # the same text under another prompt is no copy of it
                add(copied if is_closed(copied) else d, other, None)
    some = sound or [("", "")]
    for p in REFUSALS * 25:
        add(expand(p, rng, things, topics), rng.choice(some)[1], "refusal")
    for p in SOUND * 20:
        t = expand(p, rng, things, topics)
        add(t if t[-1] in ".!" else t + ".", rng.choice(some)[1], None)
    for lang in LANGUAGES * 16:
        add(foreign(lang, rng, things), rng.choice(some)[1], "foreign")
    for _ in range(400):
        add(void(rng), rng.choice(some)[1], "empty")
    return rows, [endings.rates(r) for r, _ in rows], labels


def train(sample: list[tuple[str, str]], endings: Endings) -> Detector:
    """Fitted on rows made of the sampled (response, description) pairs; deterministic."""
    rows, rates, labels = _training_rows(sample, endings, random.Random(3))
    x = features(rows, rates)
    held = np.array([xxhash.xxh32_intdigest(f"{i}") % 4 for i in range(len(rows))]) == 0
    kinds = np.array([l or "" for l in labels])
    # Refusals, foreign and void statements among the sampled rows taken for sound are found by a model of word classes and
    # dense features alone, which cannot learn the rows by heart; they are left out.
    general = hashing.assemble(len(rows), [hashing.class_grams([[_class(w) for w in words(plain(r))] for r, _ in rows], len(CLASSES))], x.dense)
    keep = np.ones(len(rows), bool)
    for d in ("refusal", "foreign", "empty"):
        y = kinds == d
        if y.any():
            p = hashing.fit(general, y, np.where(y, 3.0, 1.0), steps=60).probability(general)
            keep &= ~((kinds == "") & (p > DOUBT))
    models, thresholds = [], []
    for d in DEFECTS:
        y = kinds == d
        w = np.where(y, max(1.0, min(4.0, (kinds == "").sum() / max(1, 2 * y.sum()))), 1.0)
        if not y.any():
            models.append(hashing.Linear(np.zeros(hashing.DIMENSIONS, np.float32), np.zeros(_EXTRA, np.float32), -9.0))
            thresholds.append(0.5)
            continue
        tuned = hashing.fit(x.take(keep & ~held), y[keep & ~held], w[keep & ~held], steps=40)
        thresholds.append(hashing.best_threshold(tuned.probability(x.take(keep & held)), y[keep & held], np.where(y[keep & held], 0.4, 1.0), 0.2, 0.7))
        models.append(hashing.fit(x.take(keep), y[keep], w[keep], steps=70))
    return Detector(models, thresholds)


def pairs_of(evaluations: DataFrame) -> DataFrame:
    """eval_id, reasoning, description, judge of the rows with status ok."""
    return evaluations.where(F.col("status") == "ok").select("eval_id", F.col("scores.purpose.reasoning").alias("reasoning"), F.col("tool.description").alias("description"), F.col("judge.id").alias("judge"))


def fit_on(pairs: DataFrame, endings: DataFrame, sample: int = SAMPLE_ROWS) -> Detector:
    """A detector fitted on about `sample` of the pairs; of the counts it reads those of keys that occur in the sample."""
    n = pairs.count()
    share = min(1.0, sample / n) if n else 0.0
    rows = pairs.where(F.xxhash64("eval_id", F.lit(3)).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))).select("eval_id", "reasoning", "description").collect()
    own = [(r.reasoning or "", r.description or "") for r in sorted(rows, key=lambda r: (r.eval_id is None, r.eval_id or 0, r.reasoning or "", r.description or ""))]
    needed: dict[int, list[int]] = {}
    for r, _ in own:
        _count(r, needed)
    wanted = pairs.sparkSession.createDataFrame(pd.DataFrame({"key": np.fromiter(needed, np.int64, len(needed))}), "key long")
    counts = {r.key: (r.hits, r.uses) for r in endings.join(wanted, "key", "left_semi").collect()} if needed else {}
    return train(own, Endings(counts))


def judge_pairs(pairs: DataFrame, detector: Detector, endings: DataFrame) -> DataFrame:
    """eval_id, judge, defect (null for sound pairs) of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4000):
                part = b.slice(a, 4000)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("reasoning", "description", "end_rate", "bare_rate"))))
                own = list(dict.fromkeys(rows))  # repeated pairs are judged once
                known = dict(zip(own, detector.defects([r[:2] for r in own], [_rates(r) for r in own])))
                yield pa.RecordBatch.from_arrays([part.column("eval_id"), part.column("judge"), pa.array([known[r] for r in rows], pa.string())], names=["eval_id", "judge", "defect"])

    return with_rates(pairs, endings).select("eval_id", "judge", "reasoning", "description", "end_rate", "bare_rate").mapInArrow(run, "eval_id long, judge string, defect string")


def _rates(row: tuple) -> tuple[float, float]:
    """Rates as looked up; of an ending that has keys but no counts (there is none over whole tables) those of zero counts."""
    _, _, end, bare = row
    return (0.0, 0.0) if end is None and bare is None else (_end_rate(0, 0) if end is None else end, _bare_rate(0, 0) if bare is None else bare)


def judged(evaluations: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """eval_id, judge, defect of every row with status ok."""
    pairs = pairs_of(evaluations)
    ensure_checkpoint_dir(evaluations.sparkSession)
    endings = count_endings(pairs).checkpoint()  # read for the sample and for the open endings, counted once
    return judge_pairs(pairs, fit_on(pairs, endings, sample), endings)


def found(evaluations: DataFrame) -> DataFrame:
    """eval_id, defect of every broken pair."""
    return judged(evaluations).where("defect is not null").select("eval_id", "defect")
