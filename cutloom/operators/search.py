"""Similar frames, loops, changes and command ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .lineage import cut, discard


def mean_square(a: str, b: str) -> Column:
    """Mean squared difference of two equally long arrays, summed in order."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v) / size({a})")


def znorm(sig: str) -> Column:
    """Zero mean, unit deviation (of the population, plus a millionth): mean and deviation are taken once an array, not once a number."""
    mean = f"aggregate({sig}, 0D, (s, v) -> s + v) / size({sig})"
    deviation = f"sqrt(aggregate({sig}, 0D, (s, v) -> s + (v - m) * (v - m)) / size({sig}))"
    named = f"transform(array({mean}), m -> transform(array({deviation}), d -> transform({sig}, x -> (x - m) / (d + 1e-6))))"
    return F.expr(f"{named}[0][0]")


BROADCAST = 16 << 20


def distances(signatures: DataFrame, refs: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(ref, frame, score) of every frame to each reference: a stated query set against all rows, block by block.

    References are counted first and sent out in blocks of ``most`` bytes of numbers; each block is one pass over the frames.
    """
    queries = cut(refs.select(F.col("frame").alias("ref"), F.col("sig").alias("ref_sig")))
    size = queries.agg(F.sum(8 * F.size("ref_sig") + 16)).first()[0] or 0
    blocks = max(1, -(-size // most))
    if blocks > 1:
        queries = cut(queries.withColumn("_b", F.pmod(F.xxhash64("ref"), F.lit(blocks))))
    out = None
    for k in range(blocks):
        some = queries.where(F.col("_b") == k).drop("_b") if blocks > 1 else queries
        one = signatures.crossJoin(F.broadcast(some)).select("ref", "frame", mean_square("sig", "ref_sig").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def _matrices(sigs: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of arrays; those that are null or empty are in none."""
    whole = [None if x is None else np.asarray(x, np.float64) for x in sigs]
    size = np.array([0 if x is None else len(x) for x in whole])
    return [(at, np.stack([whole[i] for i in at])) for n in np.unique(size[size > 0]) for at in [np.flatnonzero(size == n)]]


def _scores(frames: list[tuple[np.ndarray, np.ndarray]], ref: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(known, score) of n frames to one reference: squares are summed in order, as ``mean_square`` does."""
    known, score = np.zeros(n, bool), np.full(n, -np.inf)
    for at, rows in frames:
        if rows.shape[1] == len(ref):
            total = np.zeros(len(at))
            for k in range(len(ref)):
                apart = rows[:, k] - ref[k]
                total += apart * apart
            known[at], score[at] = True, total / len(ref)
    return known, score


def closest(signatures: DataFrame, refs: DataFrame, k: int, exclude: int = 0, block: int = 8192) -> DataFrame:
    """(ref, frame, score): the k best frames of each reference in each block of about ``block`` frames, among those at least ``exclude`` from it; of equals the lower frames.

    The k best of all are among them, so only k rows a block are ranked in the end, not a row for each pair.  Blocks of frames and of references are dealt
    out by hashes and meet in tasks of bounded memory; scores are those of ``distances``.
    """
    whole = F.when(~F.exists("sig", lambda v: v.isNull()), F.col("sig"))  # pandas would read a null within as not a number
    frames, queries = cut(signatures.select("frame", whole.alias("sig"))), cut(refs.select(F.col("frame").alias("ref"), whole.alias("ref_sig")))
    many, few = max(1, -(-frames.count() // block)), max(1, -(-queries.count() // (block // 4)))
    dealt = lambda rows, key, n, name: rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    out_to = lambda rows, n, name: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = out_to(dealt(frames, "frame", many, "_i"), few, "_j"), out_to(dealt(queries, "ref", few, "_j"), many, "_i")

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        at, out = rows.frame.to_numpy(np.int64), []
        # frames by columns: one coordinate of all lies together
        sigs = [(p, np.asfortranarray(m)) for p, m in _matrices(rows.sig)]
        for ref, sig in zip(asked.ref.tolist(), asked.ref_sig, strict=True):
            plain = sig is not None and len(sig) > 0
            known, score = _scores(sigs if plain else [], np.asarray(sig, np.float64) if plain else np.zeros(0), len(at))
            some = np.flatnonzero(np.abs(at - ref) >= exclude)
            if len(some) > k:
                some = some[~(score[some] > np.partition(score[some], k - 1)[k - 1])]
            some = some[np.lexsort((at[some], score[some]))][:k]
            out.append((np.full(len(some), ref), at[some], score[some], known[some]))
        if not out:
            return pd.DataFrame({"ref": [], "frame": [], "score": []})
        ref, frame, score, known = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"ref": ref, "frame": frame, "score": pd.Series(score).astype(object).where(known, None)})

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(best, "ref long, frame long, score double")


def nearest(scored: DataFrame, k: int, exclude: int) -> DataFrame:
    """The k nearest frames of each reference that lie at least ``exclude`` from it."""
    far = scored.where(F.abs(F.col("frame") - F.col("ref")) >= exclude)
    by = Window.partitionBy("ref").orderBy("score", "frame")
    return far.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def most_ranked(k: int, exclude: int) -> int:
    """How many of the best frames ``suppressed`` may have to look at."""
    return (k + 1) * (2 * exclude - 1) + k


def suppressed(scored: DataFrame, k: int, exclude: int) -> DataFrame:
    """Greedy picks: best first, each at least ``exclude`` frames from the reference and from every earlier pick.

    A pick, like the reference, rules out 2 * exclude - 1 frames at most, so the k picks lie among the (k + 1) times as many best
    frames; only those go to one place.
    """
    most = most_ranked(k, exclude)
    scored = scored.withColumn("_r", F.row_number().over(Window.partitionBy("ref").orderBy("score", "frame"))).where(F.col("_r") <= most).drop("_r")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        ref, taken, out = int(rows.ref.iloc[0]), [], []
        for frame, score in rows.sort_values(["score", "frame"])[["frame", "score"]].itertuples(index=False):
            if abs(frame - ref) >= exclude and all(abs(frame - t) >= exclude for t in taken):
                taken.append(frame)
                out.append((ref, len(taken), frame, score))
                if len(taken) == k:
                    break
        return pd.DataFrame(out, columns=["ref", "rank", "frame", "score"])

    return scored.groupBy("ref").applyInPandas(pick, "ref long, rank long, frame long, score double")


def apart(features: DataFrame, frame: str, order: str, x: str, y: str, distance: float) -> DataFrame:
    """Features of a frame, taken in order, each at least ``distance`` from those kept before; a frame has as many as its detector gives at most."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        at = rows[x].to_numpy(float) + 1j * rows[y].to_numpy(float)
        kept: list[int] = []
        for i, z in enumerate(at):
            if not (abs(at[kept] - z) < distance).any():
                kept.append(i)
        return rows.iloc[kept]

    return features.groupBy(frame).applyInPandas(pick, features.schema)


def best_loop(signatures: DataFrame, shortest: int, longest: int, step: int, bias: float, fps: float, groups: list[str]) -> DataFrame:
    """Per group the pair of frames (a, b = a + length) that match best, length bias included; of equals the first."""
    a = signatures.where(F.col("frame") % step == 0).select(*groups, F.col("frame").alias("a"), F.col("sig").alias("sig_a"))
    tries = a.withColumn("length", F.explode(F.sequence(F.lit(shortest).cast("long"), F.lit(longest).cast("long"), F.lit(step).cast("long")))).withColumn("b", F.col("a") + F.col("length"))
    pairs = tries.join(signatures.select(*groups, F.col("frame").alias("b"), F.col("sig").alias("sig_b")), [*groups, "b"])
    scored = pairs.withColumn("score", mean_square("sig_a", "sig_b")).withColumn("rank", F.round(F.col("score") - bias * F.col("length") / fps, 9))
    return scored.groupBy(*groups).agg(F.min_by(F.struct("a", "b", "score"), F.struct("rank", "a", "length")).alias("m")).select(*groups, "m.*")


def loop_trimmed(clips: DataFrame, loops: DataFrame, key: str) -> DataFrame:
    """Clips (key, src_in, ...) cut to their best loop (key, a, b), each alone at the start of its timeline."""
    rows = clips.drop("src_out", "start").join(loops.select(key, "a", "b"), key)
    return rows.withColumn("src_out", F.col("src_in") + F.col("b")).withColumn("src_in", F.col("src_in") + F.col("a")).withColumn("start", F.lit(0).cast("long")).drop("a", "b")


def first_change(series: DataFrame, keys: list[str], at: str, diff: Column, threshold: float) -> DataFrame:
    """(keys, at): the first place where the difference passes the threshold; groups without one are left out."""
    return series.where(diff > threshold).groupBy(*keys).agg(F.min(at).alias(at))


def bisected_change(series: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """``bisected`` over a series that is a table with a row a frame, counted from 0; it is stored once."""
    frames = cut(series.select(key, "frame", F.col(value).alias("value")))
    ends = frames.groupBy(key).agg(F.max("frame").alias("last"))
    return bisected(ends, key, lambda asked: asked.join(frames, [key, "frame"]), threshold)


def bisected(ends: DataFrame, key: str, look: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(key, frame, diff): a frame that differs from the first by over the threshold while the one before does not, and how far the last differs.

    ``ends`` is (key, last), the last frame of each group; ``look`` gets the (key, frame) that are asked for and adds ``value``: it renders, decodes or looks up. It is
    called with two frames a group and then one a round, so of n frames it sees 2 + log2(n); every call's answers are stored, so none is asked for twice.
    Groups whose last frame is within the threshold are left out; where a series goes back and forth what is found need not be the earliest change.
    """
    both = cut(look(ends.select(key, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("last").cast("long")))).alias("frame"))).select(key, "frame", "value"))
    known = ends.join(both.groupBy(key).agg(F.min_by("value", "frame").alias("_first"), F.max_by("value", "frame").alias("_last")), key)
    state = cut(known.select(key, F.lit(0).cast("long").alias("a"), F.col("last").cast("long").alias("b"), "_first", F.abs(F.col("_last") - F.col("_first")).alias("diff")).where(F.col("diff") > threshold))
    longest = state.agg(F.max("b")).first()[0] or 0
    for _ in range(int(longest - 1).bit_length() if longest > 1 else 0):
        asked = state.where("b - a > 1").select(key, N.div(F.col("a") + F.col("b"), 2).alias("frame"))
        seen = look(asked).select(key, "frame", "value")
        changed = F.abs(F.col("value") - F.col("_first")) > threshold
        new = state.join(seen, key, "left").select(key, F.when(~changed, F.col("frame")).otherwise(F.col("a")).alias("a"), F.when(changed, F.col("frame")).otherwise(F.col("b")).alias("b"), "_first", "diff")
        after = cut(new)
        discard(state)
        state = after
    return state.select(key, F.col("b").alias("frame"), "diff")


def match_score(query: str) -> Column:
    """How well a command (label, keywords, category) answers a query; 0 is not at all."""
    q, label = query.strip().lower(), F.lower("label")
    if not q:
        return F.lit(1.0)
    return (
        F.when(label.startswith(q), 4.0)
        .when(label.contains(" " + q), 3.0)
        .when(label.contains(q), 2.0)
        .when(F.exists("keywords", lambda k: F.lower(k).contains(q)), 1.5)
        .when(F.col("category").contains(q), 1.0)
        .when(subsequence(label, q), 0.5)
        .otherwise(0.0)
    )


def subsequence(text: Column, q: str) -> Column:
    """Whether all characters of q occur in the text, in order."""
    return text.rlike("(?s)" + ".*".join(("\\" + c) if not c.isalnum() and c != " " else c for c in q))


def rank_commands(commands: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The best matches; a disabled command ranks a quarter lower; then by label."""
    score = match_score(query)
    rows = commands.withColumn("match", score).where("match > 0").withColumn("score", F.col("match") - F.when(F.col("enabled"), 0.0).otherwise(0.25))
    return rows.orderBy(F.desc("score"), "label", "name").limit(limit).select("name", "label", "score")
