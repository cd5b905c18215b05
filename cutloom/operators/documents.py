"""Captions, overlays, effect stacks and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .lineage import cut, discard
from .timeline import interval_join

# By effect kind, the parameter and the bound at which it changes nothing.
NEUTRAL_BELOW = {"blur": ("sigma", 0.0), "sharpen": ("strength", 0.0), "matte": ("strength", 0.001), "flicker": ("strength", 0.001), "restore": ("strength", 0.001), "depthblur": ("strength", 0.001), "look": ("strength", 0.001)}
NEUTRAL_ALWAYS = ("loop", "blend")
SECONDS = 10.0  # of captions that are dealt together


def caption_at(points: DataFrame, captions: DataFrame) -> DataFrame:
    """Each point's (seq_id, t) caption; spans are closed, and of several the last in the list shows."""
    hits = interval_join(points, captions, ["seq_id"], "t", "start", "stop", width=SECONDS, closed=True)
    shown = hits.groupBy("seq_id", "t").agg(F.max_by(F.struct("ord", "text"), "ord").alias("c")).select("seq_id", "t", "c.*")
    return points.join(shown, ["seq_id", "t"], "left")


def is_neutral(kind: str = "kind", params: str = "params") -> Column:
    """Whether an effect changes nothing."""
    get = lambda k: F.try_element_at(F.col(params), F.lit(k))
    out = F.when(F.col(kind).isin(*NEUTRAL_ALWAYS), True).when(F.col(kind) == "opacity", get("alpha") >= 0.999)
    out = out.when(F.col(kind) == "transform", (F.abs(get("scale") - 1) < 1e-8) & (get("x") == 0) & (get("y") == 0) & (get("rotation") == 0))
    for name, (key, bound) in NEUTRAL_BELOW.items():
        out = out.when(F.col(kind) == name, get(key) <= bound)
    return F.coalesce(out, F.lit(False))


def live_effects(slots: DataFrame) -> DataFrame:
    """Slots that are enabled and not neutral."""
    return slots.where(F.col("enabled") & ~is_neutral())


def effect_signature(slots: DataFrame) -> DataFrame:
    """(clip_id, signature): changes with a clip's slots (ord, slot_id, kind, enabled), their order and nothing else."""
    parts = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", F.col("slot_id").cast("string"), F.col("kind"), F.col("enabled").cast("string")).alias("t"))))
    return slots.groupBy("clip_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), ";")).alias("signature"))


def resolve_links(links: DataFrame, slots: DataFrame) -> DataFrame:
    """Links (src_clip, src_slot, dst_clip, dst_slot, role) with the clip they mean (0: their own) and whether the slot exists."""
    rows = links.withColumn("to_clip", F.when(F.col("dst_clip") == 0, F.col("src_clip")).otherwise(F.col("dst_clip")))
    there = slots.select(F.col("clip_id").alias("to_clip"), F.col("slot_id").alias("dst_slot")).distinct().withColumn("found", F.lit(True))
    return rows.join(there, ["to_clip", "dst_slot"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def link_chain(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node): everything each start reaches over edges (src, dst), in ``depth`` steps at most if given, itself not counted; cycles end.

    A step joins the frontier with the edges and drops what the start has reached already; frontiers are written to the checkpoint folder.
    """
    edges = cut(edges.select("src", "dst").distinct())
    seen = front = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    step = 0
    while (depth is None or step < depth) and not front.isEmpty():
        reached = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        front = cut(reached.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front)
        step += 1
    return seen.where("start <> node")


def linked_params(links: DataFrame, slots: DataFrame, kinds: DataFrame) -> DataFrame:
    """(src_clip, src_slot, to_clip, dst_slot, kind, role, params): what a slot's card shows of the slots it links to: direct links only, with parameters to show.

    ``slots`` are (clip_id, slot_id, kind), ``kinds`` (kind, params) what each kind of effect can show; kinds that are not registered show nothing, nor do links to nothing.
    """
    rows = resolve_links(links, slots).where("found")
    target = slots.select(F.col("clip_id").alias("to_clip"), F.col("slot_id").alias("dst_slot"), "kind").distinct()
    shown = rows.join(target, ["to_clip", "dst_slot"]).join(kinds.select("kind", "params"), "kind")
    return shown.select("src_clip", "src_slot", "to_clip", "dst_slot", "kind", "role", "params")


def link_roles(links: DataFrame, starts: DataFrame, every: int = 8) -> DataFrame:
    """(start, node, role, steps): everything each start (node) reaches over links (src, dst, role), once, with the role it was reached by and in how many steps.

    A node is reached in the fewest steps; of several links that do it, by the one from the lowest node, then with the least role.  Itself is not reached; circles end.
    One row comes out for each start and node that it reaches, which is what a walk from every start is.  A round joins the frontier; what was reached is kept
    in tables that are put into one every ``every`` rounds, and tables that nothing reads any more go.
    """
    edges = cut(links.select("src", "dst", "role").where("src <> dst").distinct())
    begin = starts.select(F.col("node").alias("start"), "node").distinct().select("start", "node", F.lit(None).cast("string").alias("role"), F.lit(0).alias("steps"))
    parts = [cut(begin)]
    front = parts[0]
    steps = 0
    while not front.isEmpty():
        steps += 1
        reached = front.select("start", F.col("node").alias("src")).join(edges, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min(F.struct("src", "role")).alias("by"))
        for part in parts:  # a few: see below
            reached = reached.join(part.select("start", "node"), ["start", "node"], "left_anti")
        front = cut(reached.select("start", "node", "by.role", F.lit(steps).alias("steps")))
        parts.append(front)
        if len(parts) > every:
            whole = parts[0]
            for part in parts[1:-1]:
                whole = whole.unionByName(part)
            merged = cut(whole)
            discard(*parts[:-1])
            parts = [merged, front]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("steps > 0").select("start", "node", "role", "steps")


def overlay_state(overlays: DataFrame, sampled: DataFrame) -> DataFrame:
    """Settings, then static parameters, then curve values, then the frame itself; the later wins.

    ``sampled`` has (overlay_id, values), a map of curve values at the frame.
    """
    rows = overlays.join(sampled, "overlay_id", "left")
    pick = F.expr("""map_from_arrays(
        array_distinct(concat(coalesce(map_keys(settings), array()), coalesce(map_keys(params), array()), coalesce(map_keys(values), array()))),
        transform(array_distinct(concat(coalesce(map_keys(settings), array()), coalesce(map_keys(params), array()), coalesce(map_keys(values), array()))),
          k -> coalesce(try_element_at(values, k), try_element_at(params, k), try_element_at(settings, k))))""")
    return rows.withColumn("state", pick)


def retext(captions: DataFrame, changes: DataFrame) -> DataFrame:
    """Captions with new words where ``changes`` (seq_id, ord, new_text) has some."""
    return captions.join(changes, ["seq_id", "ord"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def step_caption(points: DataFrame, captions: DataFrame, step: int) -> DataFrame:
    """(seq_id, t, target): the caption ``step`` on from the one that shows, kept in range; from nowhere the first, or the last going back."""
    counts = captions.groupBy("seq_id").agg(F.count("*").alias("n"))
    now = caption_at(points, captions.select("seq_id", "ord", "start", "stop", F.lit("").alias("text")))
    rows = now.join(counts, "seq_id")
    moved = N.clamp(F.col("ord") + step, 0, F.col("n") - 1)
    return rows.select("seq_id", "t", F.coalesce(moved, F.lit(0).cast("long") if step > 0 else F.col("n") - 1).cast("long").alias("target"))
