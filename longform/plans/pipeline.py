"""Entry points: outline (E2), plan (E3), text (E4) and all of it (E1), for all stories of a premise table together.

Rounds and waves are loops on the driver over tables that hold every active story; each pass of a loop is a handful of steps of
a ``RunStore``, so a run can be killed at any time and resumed. The driver sees counts of active stories and of waves only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longform import schemas
from longform.operators import outline as O
from longform.operators import parse as R
from longform.operators import planning as P
from longform.operators import prompts as T
from longform.operators import writing as W
from longform.plans import sinks
from longform.plans.store import Model, RunStore
from longform.sources.premises import resume_events

BATCH = ["story_id", "round", "val_iter"]


def _accepted_schema(id_type: str) -> str:
    return f"story_id {id_type}, event_seq bigint, round int, val_iter int, natural_id string, {schemas.EVENT}"


def _with_parsed(answers: DataFrame, keys: list[str], spec) -> DataFrame:
    return R.parse_records(answers, keys, spec)[0]


# ---- outline ---------------------------------------------------------------------------------------------------
def judged_batch(candidates: DataFrame, verdicts: DataFrame, accepted: DataFrame) -> DataFrame:
    """O4-O9, O12, O13 for one pass: every matched candidate with its verdict; accepted ones have the next ``event_seq`` of
    their story and the smallest free id (``natural_id`` is the model's).

    A pass of a story is one model response and a story has about ``max_events`` events, so both are short lists, walked in
    order by a fold over arrays."""
    matched = O.match_verdicts(candidates, verdicts).withColumnRenamed("event_id", "natural_id")
    fields = [c for c in matched.columns if c not in ("story_id", "first_pos")]
    rows = matched.groupBy("story_id").agg(
        F.array_sort(F.collect_list(F.struct("first_pos", F.struct(*fields).alias("r")))).alias("_rows"))
    taken = accepted.groupBy("story_id").agg(F.collect_list("event_id").alias("_taken"), F.max("event_seq").alias("_last"))
    none = F.array().cast("array<string>")

    def named(state: Column, row: Column) -> Column:
        own = row["r"]["natural_id"]
        tries = F.transform(F.sequence(F.lit(1), F.size(state["taken"]) + 1),
                            lambda n: F.concat(own, F.lit("_"), n.cast("string")))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(state["taken"], t)), 1)
        name = F.when(F.array_contains(state["taken"], own), free).otherwise(own)
        return F.struct(F.array_append(state["taken"], name).alias("taken"),
                        F.array_append(state["names"], name).alias("names"))

    good, bad = F.filter("_rows", lambda x: x["r"]["valid"]), F.filter("_rows", lambda x: ~x["r"]["valid"])
    s = rows.join(taken, "story_id", "left").select("story_id", good.alias("_good"), bad.alias("_bad"), F.aggregate(
        good, F.struct(F.coalesce("_taken", none).alias("taken"), none.alias("names")), named)["names"].alias("_names"),
        F.coalesce("_last", F.lit(0)).cast("long").alias("_last"))

    def out(row: Column, event_id: Column, seq: Column) -> Column:
        return F.struct(row["first_pos"].alias("first_pos"), *[row["r"][c].alias(c) for c in fields],
                        event_id.alias("event_id"), seq.cast("long").alias("event_seq"))

    accepted_rows = F.transform("_good", lambda x, i: out(x, F.get("_names", i), F.col("_last") + i + 1))
    rejected_rows = F.transform("_bad", lambda x: out(x, x["r"]["natural_id"], F.lit(None)))
    return s.select("story_id", F.inline(F.concat(accepted_rows, rejected_rows)))


def revise_round(stories: DataFrame, accepted: DataFrame, judged: DataFrame, max_val: int, ask: Callable) -> DataFrame:
    """Rejected candidates of a pass go back with their verdicts; what comes back are the candidates of pass
    ``val_iter + 1``. The last pass asks for nothing: its revision would never be validated. ``accepted`` are the events up to
    and in the pass; ``ask`` answers requests."""
    rejected = judged.where(~F.col("valid")).withColumn("event_id", F.col("natural_id"))
    answers = ask(lambda: T.req_revise(stories, accepted, rejected, max_val, prefix=False))
    revised = _with_parsed(answers, BATCH, R.EVENT_SPEC)
    return revised.withColumn("val_iter", (F.col("val_iter") + 1).cast("int"))


def build_outline(store: RunStore, premises: DataFrame, model: Model, k_candidates: int = 3, max_val: int = 2,
                  max_events: int = 30, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds over all stories that are still open; returns ``(events, relations)``.

    A story leaves the loop when it has ``max_events`` at the start of a round (O2), is complete (O1) or gets no candidates
    (O3); the loop ends when no story is left, or at the round cap (O14). ``prior`` are accepted events of an earlier
    run (S2): ``story_id, event_seq`` and the event fields, kept as they are, and ids are resolved against them.
    """
    stories = premises.select("story_id", "premise")
    schema = _accepted_schema(stories.schema["story_id"].dataType.simpleString())
    columns = [f.name for f in store.spark.createDataFrame([], schema).schema]
    done: list[str] = []
    if prior is not None:
        old = resume_events(prior).withColumn("natural_id", F.col("event_id"))
        store.step("outline/prior", lambda: old.select(
            *[F.col(c).cast("int") if c in ("round", "val_iter") else F.col(c) for c in columns]))
        done.append("outline/prior")

    def accepted() -> DataFrame:
        rows = store.read_all(done, schema.replace("event_seq bigint", "event_seq bigint, valid boolean"))
        return rows.where(F.coalesce("valid", F.lit(True))).select(*columns)

    active = stories.select("story_id")
    for r in range(O.round_cap(max_events, max_val)):
        at, no = f"outline/{r:04d}", F.lit(r).cast("int")
        n_events = accepted().groupBy("story_id").agg(F.count(F.lit(1)).alias("_n"))
        still = active
        active = store.step(f"{at}/active", lambda: still.join(n_events, "story_id", "left").where(
            F.coalesce("_n", F.lit(0)) < max_events).select("story_id"))
        if active.isEmpty():
            break
        now = stories.join(active, "story_id", "left_semi")
        so_far = accepted().join(active, "story_id", "left_semi")
        answers = store.answers(f"{at}/completeness", lambda: T.req_completeness(now, so_far).withColumn("round", no),
                                model)
        state = R.parse_completeness(answers, ["story_id", "round"]).withColumn(
            "missing_elements", F.concat_ws(",", "missing_elements"))
        answers = store.answers(f"{at}/seed", lambda: T.req_seed(now, so_far, state, k_candidates, prefix=False), model)
        candidates = store.step(f"{at}/candidates0", lambda: _with_parsed(
            answers, ["story_id", "round"], R.EVENT_SPEC).withColumn("val_iter", F.lit(0)))
        active = candidates.select("story_id").distinct()
        for v in range(max_val):
            if candidates.isEmpty():
                break
            before = accepted()
            answers = store.answers(f"{at}/validate{v}", lambda: T.req_validate(
                stories, before.join(candidates.select("story_id").distinct(), "story_id", "left_semi"), candidates,
                BATCH), model)
            verdicts = _with_parsed(answers, BATCH, R.VERDICT_SPEC)
            judged = store.step(f"{at}/judged{v}", lambda: judged_batch(candidates, verdicts, before))
            done.append(f"{at}/judged{v}")
            if v + 1 < max_val:
                candidates = store.step(f"{at}/candidates{v + 1}", lambda: revise_round(
                    stories, accepted(), judged, max_val,
                    lambda requests: store.answers(f"{at}/revise{v}", requests, model)))
    events = store.step("outline/events", accepted)
    answers = store.answers("outline/relations", lambda: T.req_relations(stories, events), model)
    relations = store.step("outline/edges", lambda: O.relations_valid(
        _with_parsed(answers, ["story_id"], R.RELATION_SPEC).withColumn("rel_seq", (F.col("pos") + 1).cast("long")), events)
        .select("story_id", "rel_seq", *schemas.RELATION_FIELDS))
    return events, relations


def graph_json(graph: DataFrame) -> DataFrame:
    return sinks.outline_rows(graph).withColumnRenamed("outline_json", "graph_json")


# ---- plan ------------------------------------------------------------------------------------------------------
def plan_weave(store: RunStore, stories: DataFrame, graph: DataFrame, sub_events: DataFrame, model: Model) -> DataFrame:
    """P5: one request a story over its graph and all its sub-events; the answer's elements, in order, are the chapters."""
    answers = store.answers("plan/weave", lambda: T.req_weave(stories, graph_json(graph), sub_events), model)
    return store.step("plan/chapters", lambda: _with_parsed(answers, ["story_id"], R.CHAPTER_SPEC).select(
        "story_id", (F.col("pos") + 1).cast("long").alias("chapter_pos"), *schemas.CHAPTER_FIELDS))


def build_plan(store: RunStore, premises: DataFrame, events: DataFrame, relations: DataFrame, model: Model
               ) -> tuple[DataFrame, DataFrame]:
    """One decomposition request per event (P1), parents set to the event asked about (P2), ids resolved over the whole
    story (P3) in story order (P4), then chapters (P5). Returns ``(sub_events, chapters)``."""
    stories = premises.select("story_id", "premise")
    graph = store.step("plan/graph", lambda: O.event_graph(events, relations, stories))
    answers = store.answers("plan/subevents", lambda: T.req_subevents(stories, graph_json(graph), events), model)

    def numbered() -> DataFrame:
        found = _with_parsed(answers, ["story_id", "event_seq", "target_event_id"], R.SUB_EVENT_SPEC)
        s = P.resolve_sub_event_ids(P.sub_event_order(P.parent_override(found)))
        return s.select("story_id", "sub_seq", *schemas.SUB_EVENT_FIELDS)

    sub_events = store.step("plan/sub_events", numbered)
    return sub_events, plan_weave(store, stories, graph, sub_events, model)


# ---- text ------------------------------------------------------------------------------------------------------
class Writer:
    """What every wave of a story run reads: slots, titles, texts of the plan. What waves share is written once, in folders by
    wave, so that a wave reads its own rows and not the whole plan."""

    def __init__(self, store: RunStore, premises: DataFrame, events: DataFrame, relations: DataFrame,
                 sub_events: DataFrame, chapters: DataFrame, model: Model, name: str = "write"):
        self.store, self.model, self.name = store, model, name
        self.stories = premises.select("story_id", "premise")
        self.events, self.relations = events, O.relations_valid(relations, events)
        self.sub_events, self.chapters = sub_events, chapters
        self.id_type = premises.schema["story_id"].dataType.simpleString()

    @cached_property
    def slots(self) -> DataFrame:
        """Slots of known sub-events with their parent event and wave (W18); unknown ones are the quarantine of W6."""
        slots = W.reading_order(self.chapters).select("story_id", "pos", "chapter_pos", "sub_event_id")

        def waves() -> DataFrame:
            w = W.writing_waves(slots, self.sub_events).select("story_id", "pos", "parent_event_id", "wave")
            return slots.join(w, ["story_id", "pos"])
        return self.store.step(f"{self.name}/slots", waves, "wave", f"story_id {self.id_type}, pos bigint, chapter_pos bigint, "
                               "sub_event_id string, parent_event_id string, wave bigint")

    @cached_property
    def scenes(self) -> DataFrame:
        """The sub-events that each wave writes."""
        def rows() -> DataFrame:
            named = self.slots.select("story_id", "sub_event_id", "wave").distinct()
            return self.sub_events.select("story_id", *schemas.SUB_EVENT_FIELDS).join(named, ["story_id", "sub_event_id"])
        return self.store.step(f"{self.name}/scenes", rows, "wave", f"story_id {self.id_type}, {schemas.SUB_EVENT}, wave bigint")

    @cached_property
    def lists(self) -> DataFrame:
        """What the contexts of each parent event have in common, by the last wave that has a slot of it."""
        def rows() -> DataFrame:
            parents = self.slots.groupBy("story_id", "parent_event_id").agg(F.max("wave").alias("last_wave"))
            return W.context_lists(self.sub_events, self.events, self.relations, parents.drop("last_wave")).join(
                parents, ["story_id", "parent_event_id"])
        return self.store.step(
            f"{self.name}/lists", rows, "last_wave", f"story_id {self.id_type}, parent_event_id string, head string, "
            "_times bigint, _subs array<struct<seq:bigint,id:string,text:string>>, last_wave bigint")

    @cached_property
    def graph(self) -> DataFrame:
        return self.store.step(f"{self.name}/graph", lambda: graph_json(
            O.event_graph(self.events, self.relations, self.stories)))

    @cached_property
    def titles(self) -> DataFrame:
        return self.store.step(f"{self.name}/titles", lambda: W.next_chapter_title(self.chapters))

    def summed_up(self, step: str, contexts: DataFrame, sub_events: DataFrame) -> DataFrame:
        answers = self.store.answers(f"{step}/compress", lambda: T.req_compress(self.stories, contexts, sub_events), self.model)
        return R.parse_compress(answers, ["story_id", "pos"]).drop("parsed_ok")

    def compress(self, step: str, slots: DataFrame, passages: DataFrame) -> DataFrame:
        """The context of each slot, made of the passages that it can see, summed up: ``summary_text,
        relevance_score`` (defaults if the answer does not parse)."""
        return self.summed_up(step, W.context_text(slots, self.sub_events, self.events, self.relations, passages),
                              self.sub_events)

    def compress_wave(self, step: str, wave: int, slots: DataFrame, earlier: DataFrame) -> DataFrame:
        """W12 for the slots of a wave; ``earlier`` are the passages of earlier waves with their parent events. All that meets
        here is dealt by story, so that the contexts themselves are not shuffled."""
        seen = earlier.join(slots.select("story_id", "parent_event_id").distinct(), ["story_id", "parent_event_id"], "left_semi")
        lists = self.lists.where(F.col("last_wave") >= wave).drop("last_wave")
        contexts = W.context_of(*(x.repartition("story_id") for x in (slots, lists)),
                                W.written_lists(seen.repartition("story_id")))
        return self.summed_up(step, contexts, self.scenes.where(F.col("wave") == wave).drop("wave"))

    def write(self, step: str, slots: DataFrame, summaries: DataFrame, sub_events: DataFrame | None = None) -> DataFrame:
        """The raw passage of each slot, from its summary."""
        answers = self.store.answers(f"{step}/write", lambda: T.req_write(
            self.stories, slots, summaries, self.titles, self.sub_events if sub_events is None else sub_events), self.model)
        return R.passage_text(answers).select("story_id", "pos", "raw_text")

    def revise(self, step: str, drafts: DataFrame, sub_events: DataFrame | None = None) -> DataFrame:
        """The revision of each draft (``pos, sub_event_id, raw_text, summary_text``); defaults stand for answers that do
        not parse: no suggestions, no issues, an empty revision."""
        answers = self.store.answers(f"{step}/revise", lambda: T.req_revise_passage(
            self.stories, self.graph, drafts, self.sub_events if sub_events is None else sub_events), self.model)
        return R.parse_revision(answers, ["story_id", "pos"]).drop("parsed_ok")

    def passages(self, step: str, wave: int, earlier: DataFrame, clock: Column | None) -> DataFrame:
        """W12-W15 for the slots of a wave, which do not see each other."""
        key = ["story_id", "pos"]
        slots = self.slots.where(F.col("wave") == wave).drop("wave")
        scenes = self.scenes.where(F.col("wave") == wave).drop("wave")
        summaries = self.compress_wave(step, wave, slots, earlier)
        drafts = slots.join(summaries, key).join(self.write(step, slots, summaries, scenes), key)
        stamp = sinks.passage_timestamp(clock) if clock is not None else F.lit(None).cast("string")
        return drafts.join(self.revise(step, drafts, scenes), key).withColumn("timestamp", stamp).select(
            *PASSAGE_COLUMNS, "parent_event_id")


PASSAGE_COLUMNS = ["story_id", "pos", "chapter_pos", "sub_event_id", *schemas.COMPRESS_FIELDS, "raw_text",
                   *schemas.REVISION_FIELDS, "timestamp"]


def build_story(store: RunStore, premises: DataFrame, events: DataFrame, relations: DataFrame, sub_events: DataFrame,
                chapters: DataFrame, model: Model, chapter_range: tuple[int, int] | None = None,
                clock: Column | None = None) -> DataFrame:
    """All passages, wave by wave. Wave ``n`` holds the n-th slot of every parent event; a passage is visible to later
    slots of its siblings only, so a wave reads passages of earlier waves and can be written in one go. Each wave's passages
    are a committed table before the next wave starts. ``chapter_range`` keeps a range of chapters (W4), which then starts
    without earlier passages. ``clock`` is a timestamp column, fixed by the job that writes a wave (W15); none by default, so
    that runs are equal.
    """
    if chapter_range is not None:
        chapters = W.chapter_range(chapters, *chapter_range)
    writer = Writer(store, premises, events, relations, sub_events, chapters, model)
    schema = (f"story_id {writer.id_type}, pos bigint, chapter_pos bigint, "
              f"sub_event_id string, {schemas.COMPRESS}, raw_text string, {schemas.REVISION}, timestamp string")
    n_waves = writer.slots.agg(F.max("wave")).first()[0] or 0
    done: list[str] = []
    for n in range(1, n_waves + 1):
        step = f"write/{n:06d}"
        earlier = store.read_all(done, f"{schema}, parent_event_id string")
        store.step(f"{step}/passages", lambda: writer.passages(step, n, earlier, clock))
        done.append(f"{step}/passages")
    return store.read_all(done, schema)


# ---- all -------------------------------------------------------------------------------------------------------
def counters(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage and story, for S7."""
    out = None
    for stage, rows in parts.items():
        c = rows.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "story_id", "n")
        out = c if out is None else out.unionByName(c)
    return out


def run_all(store: RunStore, premises: DataFrame, model: Model, k_candidates: int = 3, max_val: int = 2,
            max_events: int = 30, clock: Column | None = None) -> DataFrame:
    """Outline, plan and text of every premise, with an export after each stage: ``export/outline``,
    ``export/story_plan`` and ``export/chapters`` (JSON lines, one row a story) and ``export/counters`` (S7). A run that was
    killed goes on where it was; one that is done makes no call. Returns the chapters with their passages (W17)."""
    premises = store.step("premises", lambda: premises.select("story_id", "premise"))
    events, relations = build_outline(store, premises, model, k_candidates, max_val, max_events)
    graph = O.event_graph(events, relations, premises)
    store.sink("export/outline", lambda: sinks.outline_rows(graph))
    sub_events, chapters = build_plan(store, premises, events, relations, model)
    store.sink("export/story_plan", lambda: sinks.plan_rows(P.story_plan(premises, graph, sub_events, chapters)))
    passages = build_story(store, premises, events, relations, sub_events, chapters, model, clock=clock)
    texts = W.chapter_text(chapters, passages)
    store.sink("export/chapters", lambda: sinks.chapter_rows(premises, texts))
    store.sink("export/counters", lambda: sinks.run_counters(counters(
        {"events": events, "relations": relations, "sub_events": sub_events, "chapters": chapters, "passages": passages})))
    return texts
