"""Mixing sources to target weights by soft membership.

Texts are read once: their tokens are counted and their words hashed in one Arrow
pass, and everything else works on the hashed words. A naive Bayes classifier over
the recorded sources gives every document a posterior over domains (the sources);
it is fitted in two halves, and each half is judged by the model of the other, so no
document is judged by its own label. How far the texts and the recorded sources are to
be believed is fitted by maximum likelihood. Nonnegative rates per document are then fitted by
projected-gradient least squares so that the expected tokens of each domain match
the targets, by that posterior and by the recorded source at once: of a source's
documents those whose texts speak for an overfull domain are used less. Documents with the same membership and cap have the same rate, so the
steps run over a table of such cells; rates are a function of membership and the
few numbers of each step, never stored. Last, rates become whole copies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import FOLDER, TOKENIZER, count, encoder
from tidemark.session import discard, materialise, read_table

#: Hashed word features, and how far a long text's evidence counts (a text of more words is scaled down to so many).
FEATURES, EVIDENCE_WORDS = 1 << 13, 30
#: Grids from which the heat of the text's evidence and the noise of recorded sources are fitted.
HEATS, NOISES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)
#: Memberships are kept in steps of 1 / GRAIN.
GRAIN = 64
#: Steps stop at a residual (of a domain's share) of DONE; what is reached after MOST_STEPS is reported with its residual.
MOST_STEPS, DONE = 60, 2e-4
#: Documents rounded to whole copies together.
ROUND_ROWS = 20_000
STEP, CHUNK, KEPT_WORDS = 512, 200_000, 500_000
_WORD = re.compile(r"[^\W_]+")
_ids: dict[str, int] = {}


def features(text: str | None) -> list[int]:
    """Hashed words of a whole text, numbers as one word."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        i = _ids.get(w)
        if i is None:
            if len(_ids) >= KEPT_WORDS:
                _ids.clear()
            i = _ids[w] = zlib.crc32(b"9" if w.isdigit() else w.encode()) % FEATURES
        out.append(i)
    return out


def read_once(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens, words, half) row for row: sizes and hashed words of whole texts; null ids are left out."""
    path = f"{folder}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                texts = b.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(3)), pa.array([count(t, enc)[0] for t in texts], pa.int64()), pa.array([features(t) for t in texts], pa.list_(pa.int16()))], ["doc_id", "source", "half", "tokens", "words"]
                )

    rows = documents.where("doc_id is not null").select("doc_id", "source", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "text")
    return rows.mapInArrow(run, "doc_id bigint, source string, half int, tokens bigint, words array<smallint>")


def word_counts(rows: DataFrame, domains: list[str]) -> DataFrame:
    """(half, label, feature, n) over all rows with a domain as source, combined within each task before the exchange."""
    at = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * len(domains) * FEATURES, np.int64)
        for b in batches:
            words = b.column(2)
            group = np.array([h * len(domains) + at[s] for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            seen += np.bincount(np.repeat(group, sizes) * FEATURES + flat, minlength=len(seen))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k // FEATURES), pa.array(k % FEATURES), pa.array(seen[k])], ["g", "feature", "n"])

    known = rows.where(F.col("source").isin(domains)).select("half", "source", "words")
    return known.mapInArrow(run, "g bigint, feature bigint, n bigint").groupBy("g", "feature").agg(F.sum("n").alias("n"))


def fit_classifier(rows: DataFrame, domains: list[str]) -> np.ndarray:
    """Log probabilities (2, domains, FEATURES) of smoothed multinomial naive Bayes, one model per half.

    What reaches the driver has a fixed bound: twice domains times FEATURES counts. Other
    sources teach nothing; a domain without documents in a half is uniform.
    """
    n = np.zeros((2 * len(domains), FEATURES))
    got = word_counts(rows, domains).toPandas()
    n[got["g"].to_numpy(np.int64), got["feature"].to_numpy(np.int64)] = got["n"]
    n += 0.1
    return np.log(n / n.sum(axis=1, keepdims=True)).reshape(2, len(domains), FEATURES)


def scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, source, tokens, score) row for row: log likelihoods by domain, each half's by the other half's model; an empty text has zeros."""
    base = model - model.mean(axis=1, keepdims=True)
    k = model.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            words = whole.column(4)
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(whole.num_rows), sizes)
            other = 1 - whole.column(3).to_numpy()
            s = np.zeros((whole.num_rows, k))
            for at in range(0, len(flat), CHUNK):
                w, r = flat[at : at + CHUNK], row[at : at + CHUNK]
                for d in range(k):
                    s[:, d] += np.bincount(r, base[other[r], d, w], whole.num_rows)
            s *= np.minimum(1.0, EVIDENCE_WORDS / np.maximum(sizes, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*(whole.column(i) for i in range(3)), pa.array(list(s), pa.list_(pa.float64()))], ["doc_id", "source", "tokens", "score"])

    return rows.select("doc_id", "source", "tokens", "half", "words").mapInArrow(run, "doc_id bigint, source string, tokens bigint, score array<double>")


def _softmax(score: np.ndarray, heat: float) -> np.ndarray:
    e = np.exp((score - score.max(axis=1, keepdims=True)) / heat)
    return e / e.sum(axis=1, keepdims=True)


def _numbers(b: pa.RecordBatch, at: int, k: int) -> np.ndarray:
    return b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)


def _at(b: pa.RecordBatch, at: int, domains: list[str]) -> np.ndarray:
    """The number of each row's source, -1 for one that is no domain or null."""
    numbers = {d: i for i, d in enumerate(domains)}
    return np.array([numbers.get(x, -1) for x in b.column(at).to_pylist()], np.int64)


def fit_trust(judged: DataFrame, domains: list[str]) -> tuple[float, float]:
    """(heat, noise): how far the text's evidence and the recorded sources are to be believed, by maximum likelihood.

    A recorded source is the text's domain, or with probability ``noise`` any of the others. Both are
    taken from a grid by the likelihood of all recorded sources under scores of the other half's model: one aggregate.
    """
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(HEATS), len(NOISES)))
        for b in batches:
            at, score = _at(b, 0, domains), _numbers(b, 1, k)
            score, at = score[at >= 0], at[at >= 0]
            for i, h in enumerate(HEATS if len(at) else ()):
                p = _softmax(score, h)[np.arange(len(at)), at]
                total[i] += [np.log(p * (1 - e) + (1 - p) * e / max(k - 1, 1) + 1e-300).sum() for e in NOISES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

    got = {r["i"]: r["x"] for r in judged.select("source", "score").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    i = max(got, key=lambda i: (round(got[i], 6), -i), default=0)
    return HEATS[i // len(NOISES)], NOISES[i % len(NOISES)]


def members(judged: DataFrame, domains: list[str], caps: list[float], heat: float, noise: float) -> DataFrame:
    """(doc_id, source, tokens, member, cap): twice as many numbers as domains.

    First the domains' posterior by text and recorded source together, in steps of 1 / GRAIN, then the
    recorded source itself (the posterior again where none is recorded): the fit has to meet the targets by both.
    """
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, p = _at(b, 1, domains), _softmax(_numbers(b, 3, k), heat)
            given = np.full(p.shape, noise / max(k - 1, 1))
            given[np.arange(len(at)), at] = 1 - noise
            p = p * np.where((at >= 0)[:, None], given, 1.0)
            p = np.round(p / p.sum(axis=1, keepdims=True) * GRAIN)
            p /= p.sum(axis=1, keepdims=True)
            own = np.where((at >= 0)[:, None], np.eye(k)[at], p)
            none = np.array([x is None for x in b.column(1).to_pylist()])
            cap = np.where(at >= 0, np.array(caps)[at], np.where(none, 1.0, 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(list(np.hstack([p, own])), pa.list_(pa.float64())), pa.array(cap)], ["doc_id", "source", "tokens", "member", "cap"])

    return judged.select("doc_id", "source", "tokens", "score").mapInArrow(run, "doc_id bigint, source string, tokens bigint, member array<double>, cap double")


def rate(history: list[list[float]], member: Column, cap: Column) -> Column:
    """A document's rate after the steps so far: each moves it against its domains' residuals and back into [0, cap]."""
    r = F.least(F.lit(1.0), cap)
    if not history:
        return r
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in h]) for h in history])

    def step(acc: Column, h: Column) -> Column:
        move = F.aggregate(F.zip_with(member, h, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.least(F.greatest(acc - move, F.lit(0.0)), cap)

    return F.aggregate(steps, r, step)


def _state(cells: DataFrame, k: int, history: list, gap: np.ndarray | None, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(expected tokens, Gram matrix of what is free to move against ``gap``) at the rates of ``history`` (``full``: at the caps)."""
    steps = [np.array(h) for h in history]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            cap, tok = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            r = cap if full else np.minimum(1.0, cap)
            for h in steps:
                r = np.clip(r - m @ h, 0.0, cap)
            total[:k] += (tok * r) @ m
            if gap is not None:
                pull = m @ gap
                free = ((r > 0) | (pull < 0)) & ((r < cap) | (pull > 0))
                total[k:] += (m.T @ (m * (tok * free)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    out = np.zeros(k + k * k)
    for r in cells.select("member", "cap", "tokens").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out[:k], out[k:].reshape(k, k)


def fit_rates(cells: DataFrame, t: np.ndarray) -> tuple[list[list[float]], dict]:
    """(history, report): projected-gradient least squares of the expected tokens of each kind of membership on the rates.

    ``cells`` (member, cap, tokens), ``t`` the share wanted of each number of ``member``. The mixture's size is what the scarcest domain allows; where
    the steps settle short of a domain at that size, it is lowered to what was reached and they go on.
    A step is the gradient through the Gram matrix of the documents free to move (not held at 0 or
    their cap), so few steps suffice; each is two small aggregates of k and k * k numbers.
    """
    k = len(t)
    most, _ = _state(cells, k, [], None, full=True)
    if not most.sum():
        return [], {"residual": float(t.max()), "steps": 0, "size": 0.0, "expected": np.zeros(k)}
    total = max(float(np.min(most / t)), 1.0)
    history: list[list[float]] = []
    best, before = (np.inf, 0, total, np.zeros(k)), np.inf
    for n in range(MOST_STEPS + 1):
        have, _ = _state(cells, k, history, None)
        share = have / max(have.sum(), 1.0) * t.sum()
        residual = float(np.abs(share - t).max())
        if residual < best[0]:
            best = (residual, n, float(have.sum() / t.sum()), share)
        if residual < DONE:
            break
        gap = have / total - t
        miss = float(np.abs(gap).max())
        if miss > 0.9 * before:  # settled: this size is not to be had
            total = max(min(total * 0.999, float(np.min(have / t))), 1.0)
            gap = have / total - t
        before = miss
        _, gram = _state(cells, k, history, gap)
        h = np.linalg.solve(gram + np.eye(k) * max(float(np.trace(gram)) / k * 1e-4, 1.0), gap * total)
        history.append(np.clip(h, -1.0, 1.0).tolist())
    residual, n, size, share = best
    return history[:n], {"residual": residual, "steps": n, "size": size, "expected": share}


def whole_copies(rated: DataFrame) -> DataFrame:
    """``rated`` (doc_id, source, tokens, rate, expected) with copies: the rate, or the next whole number below or above it.

    Documents of a source are rounded in groups of about ROUND_ROWS, the longest first, each the way that
    keeps the group's tokens nearest to what its rates give; so rounding costs no more than a short text.
    """
    n = rated.count()
    groups = max(1, -(-n // ROUND_ROWS))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        owed, out = 0.0, []
        for t, r in zip(pdf.tokens.to_numpy(), pdf.rate.to_numpy()):
            low = int(r + 1e-9)
            part = r - low
            if part <= 1e-9:
                out.append(low)
                continue
            owed += part * t
            up = owed >= t / 2
            owed -= t if up else 0
            out.append(low + up)
        return pdf.assign(copies=np.array(out, np.int64))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rated.schema.fields] + ["copies bigint"])
    return rated.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).groupBy("source", "grp").applyInPandas(lambda k, p: settle(k, p.drop(columns="grp")), schema)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> tuple[DataFrame, dict]:
    """((doc_id, source, tokens, rate, copies) of every document, report).

    The mixture is as large as the scarcest domain, repeated as often as it may be, allows. Documents
    of a source without target have rate 0, those without a recorded source at most one copy; null targets
    and repeats count as 0 and 1; of repeated rows of a document the longest counts. The report has the fit's
    residual, steps, size and the expected share of each domain.
    """
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["t"] or 0), int(r["m"] or 1)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m")).collect()}
    domains = sorted(d for d, (t, _) in goal.items() if t > 0)
    if not domains:
        raise ValueError("no source has a target share")
    scale = sum(goal[d][0] for d in domains)
    t = np.array([goal[d][0] / scale for d in domains])
    rows = materialise(read_once(documents, tokenizer, folder), "words")
    judged = scores(rows, fit_classifier(rows, domains)).groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "score")).alias("x")).select("doc_id", "x.source", "x.tokens", "x.score")
    judged = materialise(judged, "judged")
    discard(spark, rows)
    heat, noise = fit_trust(judged, domains)
    table = members(judged, domains, [float(goal[d][1]) for d in domains], heat, noise)
    table = materialise(table, "members")
    discard(spark, judged)
    cells = materialise(table.where("cap > 0").groupBy("member", "cap").agg(F.sum("tokens").alias("tokens")), "cells")
    history, report = fit_rates(cells, np.tile(t, 2))
    discard(spark, cells)
    rated = table.select("doc_id", "source", "tokens", F.round(rate(history, F.col("member"), F.col("cap")), 6).alias("rate"))
    return whole_copies(rated), report | {"domains": domains, "heat": heat, "noise": noise}


def share_report(mixed: DataFrame, targets: DataFrame, report: dict | None = None) -> DataFrame:
    """(source, target_share, share, expected_share, tokens, documents, most_copies, max_repeats, residual, steps).

    Share is what the whole copies reached by recorded source, expected_share the fit's by soft membership; residual
    (the fit's largest miss of a share) and steps are the same in every row.
    """
    spark = mixed.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("total"))
    known = zip(report["domains"], map(float, report["expected"])) if report else []
    soft = spark.createDataFrame([(d, round(x, 4)) for d, x in known], "source string, expected_share double")
    fit = [F.lit(round(report["residual"], 6) if report else None).cast("double").alias("residual"), F.lit(report["steps"] if report else None).cast("int").alias("steps")]
    out = got.crossJoin(F.broadcast(total)).join(F.broadcast(goal), "source", "full").join(F.broadcast(soft), "source", "left")
    return out.select("source", "target_share", F.round(F.col("tokens") / F.col("total"), 4).alias("share"), "expected_share", "tokens", "documents", "most_copies", "max_repeats", *fit)


def _mixed(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark, sf_dir):
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark, sf_dir):
    mixed, report = _mixed(spark, sf_dir)
    return share_report(mixed, read_table(spark, sf_dir, "mix_targets"), report)
