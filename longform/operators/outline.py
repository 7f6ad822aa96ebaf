"""Outline operators (event graph): dedupe, verdict matching, accept/revise split, gates, id suffix, fold.

Inputs are long tables keyed by ``(story_id, round, val_iter)``:
candidates ``(…, pos, event_id, <event fields>)``, verdicts ``(…, pos, event_id, valid, suggestion)``,
completeness ``(story_id, round, complete, …)``. ``val_iter`` 0 holds seed candidates, ``val_iter`` v > 0 holds the
revision of the invalid candidates of ``v - 1``.

Every per-story window here runs over rounds, whose count is bounded by the round cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.functions.ids import resolve_ids
from longform.functions.records import event_json, ordered_list, relation_json
from longform.functions.seq import block_of, seq_number
from longform.session import written

BATCH = ["story_id", "round", "val_iter"]


def round_cap(max_events: int, max_val: int) -> int:
    """Rounds are capped at max(30, max_events * max_val)."""
    return max(30, max_events * max_val)


def dedupe_candidates(cands: DataFrame) -> DataFrame:
    """One row per id in a batch; the last element's value wins, the first position is kept."""
    value_cols = [c for c in cands.columns if c not in BATCH + ["event_id", "pos"]]
    last = F.max_by(F.struct(*value_cols), F.col("pos"))
    g = cands.groupBy(*BATCH, "event_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), last.alias("_v"))
    return g.select(*BATCH, "event_id", "first_pos", "last_pos", "_v.*")


def dedupe_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per id in a batch; the last one wins."""
    last = F.max_by(F.struct("valid", "suggestion"), F.col("pos"))
    g = verdicts.groupBy(*BATCH, "event_id").agg(last.alias("_v"))
    return g.select(*BATCH, "event_id", "_v.valid", "_v.suggestion")


def match_verdicts(cands: DataFrame, verdicts: DataFrame, how: str = "inner") -> DataFrame:
    """Deduped candidates joined with deduped verdicts on ``(batch, event_id)``."""
    return dedupe_candidates(cands).join(dedupe_verdicts(verdicts), BATCH + ["event_id"], how)


def unvalidated_candidates(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with no verdict; they are dropped, not revised."""
    return dedupe_candidates(cands).join(dedupe_verdicts(verdicts), BATCH + ["event_id"], "left_anti")


def accepted_split(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matched candidates with a valid verdict, in first-position order."""
    return match_verdicts(cands, verdicts).where(F.col("valid"))


def revise_queue(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matched candidates with an invalid verdict, with the verdict's suggestion as feedback."""
    return match_verdicts(cands, verdicts).where(~F.col("valid"))


def batch_counts(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matched, accepted and invalid counts per batch (missing batches have none)."""
    m = match_verdicts(cands, verdicts)
    return m.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.sum(F.col("valid").cast("long")).alias("n_accepted"),
        F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))


def validation_live_iters(cands: DataFrame, verdicts: DataFrame, max_val: int) -> DataFrame:
    """A validation pass ``v`` runs only if ``v < max_val`` and every earlier pass of the round had an invalid
    candidate. Returns every candidate batch with its counts and ``live`` flag."""
    told = dedupe_verdicts(verdicts).select(*BATCH, "event_id", "valid", F.lit(True).alias("_matched"))
    b = (cands.select(*BATCH, "event_id").distinct().join(told, BATCH + ["event_id"], "left").groupBy(*BATCH).agg(
        F.count("_matched").alias("n_matched"), F.count_if("valid").alias("n_accepted"),
        F.count_if(~F.col("valid")).alias("n_invalid")))
    # passes per round are bounded by max_val, so this window is small
    w = Window.partitionBy("story_id", "round").orderBy("val_iter").rowsBetween(Window.unboundedPreceding, -1)
    prior_clean = F.coalesce(F.min((F.col("n_invalid") > 0).cast("int")).over(w), F.lit(1))
    consecutive = F.col("val_iter") == F.row_number().over(Window.partitionBy("story_id", "round").orderBy("val_iter")) - 1
    return b.withColumn("live", (prior_clean == 1) & consecutive & (F.col("val_iter") < max_val))


def gate_complete(completeness: DataFrame) -> DataFrame:
    """O1: first round whose completeness check says the outline is complete."""
    return (completeness.where(F.col("complete")).groupBy("story_id")
            .agg(F.min("round").alias("complete_round")))


def gate_no_candidates(cands: DataFrame) -> DataFrame:
    """O3: first round with no seed candidates (rounds are played 0, 1, 2, … without gaps)."""
    seeds = cands.where(F.col("val_iter") == 0).select("story_id", "round").distinct()
    w = Window.partitionBy("story_id").orderBy("round")
    seeds = seeds.withColumn("_rn", F.row_number().over(w) - 1)
    return seeds.groupBy("story_id").agg(
        F.sum((F.col("round") == F.col("_rn")).cast("long")).cast("int").alias("empty_round"))


def accepted_per_round(cands: DataFrame, verdicts: DataFrame, max_val: int) -> DataFrame:
    """Accepted count per ``(story, round)`` over live validation passes only."""
    live = validation_live_iters(cands, verdicts, max_val).where(F.col("live"))
    return live.groupBy("story_id", "round").agg(F.sum("n_accepted").alias("n_accepted"))


def gate_max_events(cands: DataFrame, verdicts: DataFrame, max_events: int, max_val: int,
                    prior: DataFrame | None = None) -> DataFrame:
    """O2: events accepted before each round (prior ones included); the first round starting at or above
    ``max_events`` stops the story. The cap is soft: the round that crosses it keeps all it accepts."""
    rounds = cands.where(F.col("val_iter") == 0).select("story_id", "round").distinct()
    acc = rounds.join(accepted_per_round(cands, verdicts, max_val), ["story_id", "round"], "left")
    acc = acc.fillna(0, ["n_accepted"])
    if prior is not None:
        p = prior.groupBy("story_id").agg(F.count(F.lit(1)).alias("n_prior"))
        acc = acc.join(p, "story_id", "left")
    else:
        acc = acc.withColumn("n_prior", F.lit(None).cast("long"))
    # rounds per story are bounded by the round cap
    w = Window.partitionBy("story_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_accepted").over(w), F.lit(0)) + F.coalesce(F.col("n_prior"), F.lit(0))
    acc = acc.withColumn("accepted_before", before.cast("long"))
    return acc.select("story_id", "round", "n_accepted", "accepted_before",
                      (F.col("accepted_before") >= max_events).alias("at_cap"))


def _with_stop(rows: DataFrame, completeness: DataFrame, max_events: int, max_val: int,
               prior: DataFrame | None) -> DataFrame:
    """Adds ``accepted_before`` (of the row's round) and ``stop_round``, the first round not played: min of complete,
    capped, empty and the round cap. ``rows`` are ``(story_id, round, seeded, n_accepted)``, a bounded number of
    rounds a story, so that its windows, all on ``story_id``, share one small shuffle."""
    limit = round_cap(max_events, max_val)
    n_prior = F.lit(0)
    if prior is not None:
        rows = rows.join(prior.groupBy("story_id").agg(F.count(F.lit(1)).alias("_prior")), "story_id", "left")
        n_prior = F.coalesce("_prior", F.lit(0))
    story = Window.partitionBy("story_id")
    earlier = story.orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*rows.columns,
                       (F.coalesce(F.sum("n_accepted").over(earlier), F.lit(0)) + n_prior).alias("accepted_before"),
                       F.coalesce(F.sum(F.col("seeded").cast("long")).over(earlier), F.lit(0)).alias("_nth"))
    in_play = F.col("seeded") & (F.col("round") < limit)
    capped = F.min(F.when(in_play & (F.col("accepted_before") >= max_events), F.col("round"))).over(story)
    empty = F.sum((in_play & (F.col("round") == F.col("_nth"))).cast("long")).over(story)
    rows = rows.select(*rows.columns, capped.alias("_capped"), empty.alias("_empty"))
    rows = rows.join(gate_complete(completeness), "story_id", "left")
    stop = F.least(F.coalesce("complete_round", F.lit(limit)), F.col("_empty"), F.coalesce("_capped", F.lit(limit)),
                   F.lit(limit))
    return rows.withColumn("stop_round", stop.cast("int"))


def stop_rounds(cands: DataFrame, verdicts: DataFrame, completeness: DataFrame, max_events: int, max_val: int,
                prior: DataFrame | None = None) -> DataFrame:
    """First round not played per story: min of complete, capped, empty and the round cap. Rounds recorded beyond the
    cap count as one, which keeps their story in the result."""
    limit = round_cap(max_events, max_val)
    live = validation_live_iters(cands, verdicts, max_val)
    rounds = live.groupBy("story_id", F.least("round", F.lit(limit)).alias("round")).agg(
        F.max(F.col("val_iter") == 0).alias("seeded"),
        F.sum(F.when(F.col("live"), F.col("n_accepted")).otherwise(0)).alias("n_accepted"))
    stops = _with_stop(rounds, completeness, max_events, max_val, prior)
    stops = stops.groupBy("story_id").agg(F.min("stop_round").alias("stop_round"))
    if prior is not None:
        stops = stops.join(prior.select("story_id").distinct(), "story_id", "full").fillna(0, ["stop_round"])
    return stops


def played_batches(cands: DataFrame, verdicts: DataFrame, completeness: DataFrame, max_events: int, max_val: int,
                   prior: DataFrame | None = None) -> DataFrame:
    """Live passes of rounds before the stop round, with ``n_before``: events of the story, prior ones included, that
    are accepted before the batch."""
    live = validation_live_iters(cands, verdicts, max_val)
    live = live.where(F.col("live") & (F.col("round") < round_cap(max_events, max_val)))
    rows = live.select(*BATCH, (F.col("val_iter") == 0).alias("seeded"), "n_accepted")
    passes = (Window.partitionBy("story_id", "round").orderBy("val_iter")
              .rowsBetween(Window.unboundedPreceding, -1))
    played = _with_stop(rows, completeness, max_events, max_val, prior)
    played = played.withColumn("_passes", F.coalesce(F.sum("n_accepted").over(passes), F.lit(0)))
    return played.where(F.col("round") < F.col("stop_round")).select(
        *BATCH, (F.col("accepted_before") + F.col("_passes")).alias("n_before"))


def accepted_in_play(cands: DataFrame, verdicts: DataFrame, completeness: DataFrame, max_events: int,
                     max_val: int, prior: DataFrame | None = None) -> DataFrame:
    """Accepted candidates of live passes of rounds before the stop round."""
    played = played_batches(cands, verdicts, completeness, max_events, max_val, prior)
    return accepted_split(cands, verdicts).join(played.drop("n_before"), BATCH)


def append_accepted(accepted: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Accepted events appended after prior events in (round, pass, position) order -> ``event_seq``."""
    a = accepted.withColumn("_o1", F.lit(1)).withColumn("_o2", F.col("round")).withColumn(
        "_o3", F.col("val_iter")).withColumn("_o4", F.col("first_pos").cast("long"))
    if prior is not None:
        p = prior.withColumn("_o1", F.lit(0)).withColumn("_o2", F.lit(-1)).withColumn(
            "_o3", block_of("event_seq").cast("int")).withColumn("_o4", F.col("event_seq").cast("long")).drop("event_seq")
        a = a.unionByName(p, allowMissingColumns=True)
    a = seq_number(a, ["story_id"], ["_o4"], "event_seq",
                   block=[F.col("_o1"), F.col("_o2"), F.col("_o3")])
    return a.drop("_o1", "_o2", "_o3", "_o4")


def resolve_event_ids(events: DataFrame) -> DataFrame:
    """Colliding event ids get the smallest free ``_n`` suffix, in ``event_seq`` order."""
    r = resolve_ids(events, ["story_id"], "event_id", "event_seq", "_lf_resolved")
    return r.withColumnRenamed("event_id", "natural_id").withColumnRenamed("_lf_resolved", "event_id")


def accepted_events(cands: DataFrame, verdicts: DataFrame, completeness: DataFrame, max_events: int, max_val: int,
                    prior: DataFrame | None = None) -> DataFrame:
    """O13 on recorded batches: ``append_accepted(accepted_in_play(...))`` in one pass, since the batches already know
    how many events come before them; an event's number is that plus its place in the batch."""
    played = played_batches(cands, verdicts, completeness, max_events, max_val, prior)
    place = F.row_number().over(Window.partitionBy(*BATCH).orderBy("first_pos"))
    acc = accepted_split(cands, verdicts).join(played, BATCH)
    acc = acc.withColumn("event_seq", (F.col("n_before") + place).cast("long")).drop("n_before")
    if prior is None:
        return acc
    first = seq_number(prior.withColumnRenamed("event_seq", "_prior_seq"), ["story_id"], ["_prior_seq"], "event_seq",
                       block=[block_of("_prior_seq")]).drop("_prior_seq")
    return acc.unionByName(first, allowMissingColumns=True)


def outline_fold(cands: DataFrame, verdicts: DataFrame, completeness: DataFrame, max_events: int, max_val: int,
                 prior: DataFrame | None = None) -> DataFrame:
    """Replay recorded responses of all rounds to the final accepted event list. The accepted events are written
    to the shared folder once; ids are resolved from that table."""
    return resolve_event_ids(written(accepted_events(cands, verdicts, completeness, max_events, max_val, prior)))


def relations_valid(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Keep edges whose two ends are accepted events of the story."""
    ids = events.select("story_id", "event_id")
    src = ids.withColumnRenamed("event_id", "source_event_id")
    tgt = ids.withColumnRenamed("event_id", "target_event_id")
    return (relations.join(src, ["story_id", "source_event_id"], "left_semi")
            .join(tgt, ["story_id", "target_event_id"], "left_semi"))


def event_graph(events: DataFrame, relations: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """One row per story: ``nodes`` in ``event_seq`` order and ``edges`` in list order (kept as given,
    duplicates included). With ``stories``, one without events or edges gets empty lists."""
    nodes = events.groupBy("story_id").agg(
        ordered_list(F.struct(*[F.col(c) for c in _event_fields()]), F.col("event_seq")).alias("nodes"))
    edges = relations.groupBy("story_id").agg(
        ordered_list(F.struct("type", "source_event_id", "target_event_id", "rationale"),
                     F.col("rel_seq")).alias("edges"))
    base = stories.select("story_id") if stories is not None else nodes.select("story_id")
    empty_edges = F.array().cast("array<struct<type:string,source_event_id:string,target_event_id:string,"
                                 "rationale:string>>")
    g = base.join(nodes, "story_id", "left").join(edges, "story_id", "left")
    empty_nodes = F.array().cast(nodes.schema["nodes"].dataType)
    return g.select("story_id", F.coalesce("nodes", empty_nodes).alias("nodes"),
                    F.coalesce("edges", empty_edges).alias("edges"))


def _event_fields():
    from longform.schemas import EVENT_FIELDS
    return EVENT_FIELDS


__all__ = [name for name in dir() if not name.startswith("_")] + ["event_json", "relation_json"]
