"""Words on a clock and on the lanes of speakers.

A clip's words are put on the times of another sequence by alignment, a clip at a time over Arrow batches;
all that follows (coverage by turns, votes of recognisers, which text and which clock a clip gets) are joins
and aggregates. Clips are short: what is collected a clip is a clip's own words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import DEV, default_folder
from .joins import interval_join, point_in_interval
from .latest import latest
from .sequences import cut_lineage
from .texts import SLICE, aligned, plain_token, slots_of, spread

#: The system name that a clip's own text takes part under.
OWN = "__text__"
#: The length in seconds of the bins in which spans meet.
BIN = 4.0


def partners(ref: Sequence[str], other: Sequence[str]) -> list[int | None]:
    """For each word of ref the index of the equal word that a cheapest alignment gives it, or None. Words
    are equal if they are so without case and punctuation; of equally cheap alignments that is taken which,
    from the end, replaces before it deletes, and deletes before it inserts."""
    a, b = [plain_token(w) for w in ref], np.array([plain_token(w) for w in other], object)
    cost = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    cost[0] = step = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        # the best without an insertion, then insertions as a running minimum
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != w))
        cost[i] = np.minimum.accumulate(np.concatenate([[i], best]) - step) + step
    out: list[int | None] = [None] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if cost[i, j] == cost[i - 1, j - 1] + (b[j - 1] != a[i - 1]):
            i, j = i - 1, j - 1
            out[i] = j if b[j] == a[i] else None
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def on_clock(words: Sequence[str], seed: Sequence[str]) -> list[int | None]:
    """For each word the index of the seed word whose time it takes: that which it equals or replaces in an
    alignment of the words as they are written; None for words that the seed lacks."""
    if not words or not seed:
        return [None] * len(words)
    out, at = [], 0
    for s in default_folder().align(list(seed), list(words), folded=False):
        if s.hyp:
            out.append(at if s.ref else None)
        at += len(s.ref)
    return out


def _placing(clip: str, find):
    """Makes batches (clip, pos, word, start, end) of batches (clip, words, seed): SLICE clips at a time are
    Python objects, and what comes of them is a batch of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                of, pos, said, spans = [], [], [], []
                for k, (words, seed) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    words, seed = words or [], seed or []
                    at = find(words, [s["word"] for s in seed])
                    of += [k] * len(words)
                    pos += range(len(words))
                    said += words
                    spans += [(None, None) if i is None else (seed[i]["start"], seed[i]["end"]) for i in at]
                start, end = ([None if x[k] != x[k] else x[k] for x in spans] for k in (0, 1))
                columns = [b.column(0).take(pa.array(of, pa.int64())), pa.array(pos, pa.int32()), pa.array(said, pa.string()), pa.array(start, pa.float64()), pa.array(end, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [clip, "pos", "word", "start", "end"])

    return run


def _placed(clips: DataFrame, clip: str, find) -> DataFrame:
    """Rows (clip, pos, word, start, end) of clips (clip, words, seed: array of (word, start, end))."""
    kind = clips.schema[clip].dataType.simpleString()
    return spread(clips.select(clip, "words", "seed"), clip).mapInArrow(_placing(clip, find), f"{clip} {kind}, pos int, word string, start double, end double")


def timed(words: DataFrame, clip: str) -> DataFrame:
    """(clip, seed): each clip's words (clip, pos, word, start, end) as an array in order."""
    return words.groupBy(clip).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end"))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("seed"))


def placed(texts: DataFrame, seeds: DataFrame, clip: str, text: str = "text") -> DataFrame:
    """(clip, pos, word, start, end): each text's words on the clock of the clip's seed words (clip, pos,
    word, start, end). A word that the seed lacks, and every word of a clip without a seed, has no time: a
    guessed one would put it at a moment when nobody said it. A null text has no words."""
    own = texts.select(clip, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "").alias("words"))
    return _placed(own.join(timed(seeds, clip), clip, "left"), clip, on_clock)


def matched(reference: DataFrame, other: DataFrame, clip: str) -> DataFrame:
    """(clip, pos, word, start, end): the words of the reference (clip, pos, word, ...) in order, each with
    the span of its equal partner in the other side's words, null where it has none."""
    words = timed(reference, clip).select(clip, F.transform("seed", lambda x: x["word"]).alias("words"))
    return _placed(words.join(timed(other, clip), clip, "left"), clip, partners)


def boundary_differences(reference: DataFrame, other: DataFrame, clip: str) -> DataFrame:
    """(clip, pos, word, start_ms, end_ms, max_ms, switched, devanagari): how far apart two systems put the
    words that both have; switched words stand beside one of another script."""
    own = reference.where("start is not null and end is not null")
    partner = matched(own, other.where("start is not null and end is not null"), clip).where("start is not null")
    in_order = Window.partitionBy(clip).orderBy("pos")
    deva = F.col("word").rlike(DEV.pattern)
    own = own.withColumn("devanagari", deva).withColumn("switched", F.coalesce(F.lag("devanagari").over(in_order) != F.col("devanagari"), F.lit(False)) | F.coalesce(F.lead("devanagari").over(in_order) != F.col("devanagari"), F.lit(False)))
    own = own.select(clip, (F.row_number().over(in_order) - 1).alias("pos"), "word", F.col("start").alias("a"), F.col("end").alias("b"), "switched", "devanagari")
    ms = lambda x, y: F.round(F.abs(F.col(x) - F.col(y)) * 1000, 1)
    both = own.join(partner.select(clip, "pos", "start", "end"), [clip, "pos"]).withColumn("start_ms", ms("a", "start")).withColumn("end_ms", ms("b", "end"))
    return both.select(clip, "pos", "word", "start_ms", "end_ms", F.greatest("start_ms", "end_ms").alias("max_ms"), "switched", "devanagari")


def by_turns(words: DataFrame, turns: DataFrame, on: list[str], pos: str = "pos") -> DataFrame:
    """words with `speaker`: who speaks during most of a word's span, of equal ones the lowest; null where
    no turn touches it or it has no span. turns: on, turn_start, turn_end, speaker. A word without length
    counts a turn that holds its moment as one. Spans meet in bins, so that a key with very many turns is
    many tasks, and coverage is summed before it is shuffled."""
    spans = words.where("start is not null and end is not null").select(*on, pos, "start", "end")
    turns = turns.select(*on, "turn_start", "turn_end", "speaker")
    met = interval_join(spans.where("end > start"), turns, on, ("start", "end"), ("turn_start", "turn_end"), BIN)
    share = met.select(*on, pos, "speaker", (F.least("end", "turn_end") - F.greatest("start", "turn_start")).alias("share"))
    moments = point_in_interval(spans.where("end <= start").withColumnRenamed("start", "at").select(*on, pos, "at"), turns, on, "at", ("turn_start", "turn_end"), BIN)
    share = share.unionByName(moments.select(*on, pos, "speaker", F.lit(1.0).alias("share")))
    covered = share.groupBy(*on, pos, "speaker").agg(F.round(F.sum("share"), 9).alias("share"))
    most = covered.groupBy(*on, pos).agg(F.min(F.struct((-F.col("share")).alias("less"), "speaker"))["speaker"].alias("speaker"))
    return words.join(most, [*on, pos], "left")


def lanes(clips: DataFrame, labels: DataFrame, saved: DataFrame, hypotheses: DataFrame, words: DataFrame, turns: DataFrame, approved: Sequence[str] = ("accepted_unchanged", "edited")) -> DataFrame:
    """(clip, pos, word, start, end, speaker, proposed, source, base): the lanes that a clip opens with.

    clips: clip, run, seed (a hypothesis). Where the newest row of saved (clip, label, run, created_at,
    words: array of (word, start, end, speaker, proposed, source)) is of the clip's run and has words, they
    are the lanes. Else the text is that of the newest label (clip, id, created_at, disposition, text), if
    approved and not empty, else the seed's (hypothesis, clip, kind, text); it stands on the clock of the
    seed's words (hypothesis, pos, word, start, end), or if none of those has a time, of the recogniser
    (kind "asr") with most that have one, and each word on the lane that its turn (clip, turn_start,
    turn_end, speaker) gives it. clips without any text have no rows.
    """
    newest = latest(saved.select("clip", F.col("label").alias("saved"), F.col("run").alias("saved_run"), "created_at", F.col("words").alias("kept")), ["clip"], F.desc("created_at"), F.desc("saved"))
    own = clips.join(newest, "clip", "left").withColumn("as_saved", F.coalesce((F.col("saved_run") == F.col("run")) & (F.size("kept") > 0), F.lit(False)))
    again = own.where("as_saved").select("clip", F.posexplode("kept").alias("pos", "w")).select("clip", "pos", "w.*", F.lit("speakers").alias("base"))

    label = latest(labels, ["clip"], F.desc("created_at"), F.desc("id")).select("clip", F.when(F.col("disposition").isin(*approved) & (F.col("text") != ""), F.col("text")).alias("label_text"))
    seed_text = hypotheses.select(F.col("hypothesis").alias("seed"), F.col("text").alias("seed_text"))
    open_ = own.where("not as_saved").select("clip", "seed").join(label, "clip", "left").join(seed_text, "seed", "left")
    texts = open_.select("clip", "seed", F.coalesce("label_text", "seed_text").alias("text"), F.when(F.col("label_text").isNotNull(), "label").otherwise("seed").alias("base"))

    has_time = words.groupBy("hypothesis").agg(F.count(F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), 1)).alias("n")).where("n > 0")
    clocks = hypotheses.join(has_time, "hypothesis").join(texts.select("clip", "seed"), "clip").where((F.col("hypothesis") == F.col("seed")) | (F.col("kind") == "asr"))
    clock = latest(clocks, ["clip"], F.desc(F.coalesce(F.col("hypothesis") == F.col("seed"), F.lit(False))), F.desc("n"), "hypothesis").select("clip", "hypothesis")
    seeds = words.join(clock, "hypothesis").select("clip", "pos", "word", "start", "end")
    laned = by_turns(placed(texts, seeds, "clip"), turns, ["clip"]).join(texts.select("clip", "base"), "clip")
    return again.unionByName(laned.select("clip", "pos", "word", "start", "end", "speaker", F.col("speaker").alias("proposed"), F.lit("label").alias("source"), "base"))


def slot_words(words: DataFrame, clip: str, threshold: float = 0.45) -> DataFrame:
    """(clip, slot, system, position, word, start, end): the words (clip, system, position, word, start,
    end) that have a time, with the moment that each stands at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "system", "position", "word", "start", "end"]
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b, of, rows = whole.slice(first, SLICE), [], []
                for k, words in enumerate(b.column(1).to_pylist()):
                    spans = {(w["system"], w["position"]): (w["start"], w["end"]) for w in words}
                    found = slots_of([(w["system"], w["position"], w["word"], w["start"], w["end"]) for w in words], threshold)
                    own = [(i, s, p, w, *spans[s, p]) for i, x in enumerate(found) for s, (p, w) in x["words"].items()]
                    of += [k] * len(own)
                    rows += own
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], [clip, *names])

    kind = words.schema[clip].dataType.simpleString()
    own = words.select(clip, "system", F.col("position").cast("int").alias("position"), "word", "start", "end").where("start is not null and end is not null")
    listed = own.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct("system", "position", "word", "start", "end"))).alias("words"))
    return spread(listed, clip).mapInArrow(run, f"{clip} {kind}, slot int, system string, position int, word string, start double, end double")


def plain(word: Column) -> Column:
    """The word without case and punctuation, as moments compare it."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(plain_token)

    return run(word)


def same_word(a: Column, b: Column) -> Column:
    """Whether two words are one by the folder in force."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        f = default_folder()
        return pd.Series([bool(f.same(p, q)) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def holes(slotted: DataFrame, clip: str, least: int = 2) -> DataFrame:
    """(clip, slot, word, start, end, systems): the moments of slotted words at which the clip's own text
    (the system OWN) has none, with the word that most systems wrote there, if at least `least` did: of
    equally frequent ones that of the first system; as the first system that wrote it has it."""
    heard = slotted.withColumn("token", plain(F.col("word")))
    votes = heard.groupBy(clip, "slot", "token").agg(
        F.count("*").alias("n"), F.min("system").alias("first"), F.min_by(F.struct("word", "start", "end"), "system").alias("as"), F.array_sort(F.collect_list("system")).alias("systems"), F.max(F.col("system") == OWN).alias("own")
    )
    best = votes.groupBy(clip, "slot").agg(F.max("own").alias("own"), F.min_by(F.struct("n", "token", "as", "systems"), F.struct((-F.col("n")).alias("less"), "first")).alias("b"))
    chosen = best.where(~F.col("own") & (F.col("b.token") != "") & (F.col("b.n") >= least))
    return chosen.select(clip, "slot", "b.as.word", F.round("b.as.start", 3).alias("start"), F.round("b.as.end", 3).alias("end"), "b.systems", ((F.col("b.as.start") + F.col("b.as.end")) / 2).alias("middle"))


def not_near(found: DataFrame, own: DataFrame, clip: str, near: float = 0.6, same=same_word) -> DataFrame:
    """The rows of found (clip, slot, word, middle) without a timed own word (clip, word, start, end) that
    is the same and whose middle is at most `near` seconds away. Both meet in bins of that length, an own
    word in its own and the two beside it; only words that close are compared."""
    middle = (F.col("start") + F.col("end")) / 2
    bins = own.where("start is not null and end is not null").select(F.col(clip).alias("__clip"), F.col("word").alias("__word"), middle.alias("__middle"))
    bins = bins.withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("__middle") / near) + k)))
    met = found.withColumn("__at", F.floor(F.col("middle") / near)).join(bins, (F.col(clip) == F.col("__clip")) & (F.col("__at") == F.col("__bin"))).where(F.abs(F.col("__middle") - F.col("middle")) <= near)
    said = met.where(same(F.col("__word"), F.col("word"))).select(clip, "slot").distinct()
    return found.join(said, [clip, "slot"], "left_anti")


def candidates(own: DataFrame, words: DataFrame, clip: str, threshold: float = 0.45, least: int = 2, near: float = 0.6, same=same_word) -> DataFrame:
    """(clip, word, start, end, systems): what at least `least` recognisers heard (words: clip, system,
    position, word, start, end) at moments where the clip's own words (clip, pos, word, start, end) have
    nothing, and have not the same word within `near` seconds either."""
    text = own.select(clip, F.lit(OWN).alias("system"), F.col("pos").alias("position"), "word", "start", "end")
    # read twice below, and the moments behind it are dear
    found = cut_lineage(holes(slot_words(words.select(*text.columns).unionByName(text), clip, threshold), clip, least))
    return not_near(found, own, clip, near, same).select(clip, "word", "start", "end", "systems")


#: A word of an exported text: Latin letters, digits and apostrophes, or Devanagari without its stops.
TEXT_WORD = "[A-Za-z0-9']+|[ऀ-ॣ०-ॿ]+"
#: A word as the aligner splits one: stops within Devanagari too.
SPAN_WORD = "[A-Za-z0-9']+|[ऀ-ॿ]+"


def respelled(clips: DataFrame, spans: str, text: str, table: Column | None = None) -> DataFrame:
    """clips with `words`: the spans (array of (word, start, end)) as the words of the text. Each span's
    word is split as the text is, its pieces are looked up in the table (a map of words), and what comes of
    it, perhaps several words, has the span's time. Null unless they spell the text: no time is guessed."""
    found = lambda c: F.regexp_extract_all(c, F.lit(TEXT_WORD), F.lit(0))
    written = (lambda p: found(F.coalesce(F.try_element_at(table, p), p))) if table is not None else (lambda p: F.array(p))
    each = F.transform(F.col(spans), lambda s: F.transform(F.flatten(F.transform(found(s["word"]), written)), lambda w: F.struct(w.alias("word"), s["start"].alias("start"), s["end"].alias("end"))))
    out = clips.withColumn("words", F.flatten(each))
    return out.withColumn("words", F.when(F.transform("words", lambda w: w["word"]) == found(F.coalesce(F.col(text), F.lit(""))), F.col("words")))


def seed_spans(clips: DataFrame, words: str, text: str) -> DataFrame:
    """clips with `spans`: the seed's words, an array of (word, start, end), where they are the text's token
    for token and all have a time; else null. A text without tokens has none."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SPAN_WORD), F.lit(0))
    whole = (F.size(tokens) > 0) & (F.transform(F.col(words), lambda w: w["word"]) == tokens) & F.forall(F.col(words), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    return clips.withColumn("spans", F.when(whole, F.col(words)))


#: Where a word on a lane may come from.
SOURCES = ("label", "recogniser", "typed", "copy")
#: The shortest span of a word, and how far past its clip's end it may reach, in seconds.
LEAST_WORD, PAST_END = 0.02, 0.05


def lane_problems(words: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, pos, problem): all that makes submitted lanes unfit to be stored. words: clip, pos, word, start,
    end, speaker, suggested, source; clips: clip, seconds, speakers (an array). A clip without words is one
    problem, at pos null: an empty clip is flagged, not attributed. Words are not sorted: a task holds its
    clips and has words pass by."""
    of = words.join(clips.select("clip", "seconds", F.col("speakers").alias("__known")).hint("shuffle_hash"), "clip")
    text = F.trim(F.coalesce("word", F.lit("")))
    start, end = F.col("start"), F.col("end")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    span = (
        F.when(start.isNull() | end.isNull(), "no span").when(~(finite(start) & finite(end)), "span is not a number")
        .when((start < 0) | (end > F.col("seconds") + PAST_END), "outside the clip").when(end - start < LEAST_WORD - 1e-9, "too short")
    )
    known = lambda c: F.array_contains("__known", F.col(c))
    each = F.array_compact(F.array(
        F.when((text == "") | text.rlike(r"\s"), "not one word"), F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown source"), span,
        F.when(F.col("speaker").isNull(), "on no lane").when(~known("speaker"), "unknown speaker"), F.when(F.col("suggested").isNotNull() & ~known("suggested"), "unknown suggestion"),
    ))
    empty = clips.join(words.select("clip").distinct(), "clip", "left_anti").select("clip", F.lit(None).cast("int").alias("pos"), F.lit("no words").alias("problem"))
    return of.select("clip", F.col("pos").cast("int").alias("pos"), F.explode(each).alias("problem")).unionByName(empty)


def attributions(words: DataFrame, submitted: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, label words, refusals) of submitted lanes (clip, task, run, annotator, seconds, speakers), whose words are as
    for lane_problems, with proposed. A clip is refused if its run is no longer its current one (clip, run),
    or for its first problem; the others give a label each, with the text that their words spell in order
    of start and whether any word stands on another lane than proposed, and their words in that order."""
    problems = lane_problems(words, submitted).groupBy("clip").agg(F.min_by("problem", F.coalesce("pos", F.lit(-1))).alias("problem"))
    at = submitted.join(current.select("clip", F.col("run").alias("__run")), "clip", "left").join(problems, "clip", "left")
    judged = at.withColumn("refused", F.when(~F.col("run").eqNullSafe(F.col("__run")), "diarized again").otherwise(F.col("problem")))
    good = judged.where("refused is null").select("clip", "task", "run", "annotator")
    order = F.row_number().over(Window.partitionBy("clip").orderBy("start", "end", "pos")) - 1
    kept = words.join(good.select("clip"), "clip", "left_semi").withColumn("position", order)
    kept = kept.select("clip", "position", F.trim("word").alias("word"), "start", "end", "speaker", "proposed", "suggested", "source")
    spelled = kept.groupBy("clip").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.count_if(~F.col("speaker").eqNullSafe(F.col("proposed"))).alias("moved"), F.count_if(F.col("source") != "label").alias("added"),
    )
    return good.join(spelled, "clip"), kept, judged.where("refused is not null").select("clip", "task", "refused")


def clip_detail(clips: DataFrame, runs: DataFrame, version: str | None = None) -> DataFrame:
    """clips (run, clip, ref, hyp, ...) with `steps`, their alignment as it is made today, and `stale`: whether
    their run (run, version) was scored by other rules, so that its stored counts may differ from it."""
    now = version or default_folder().version
    of = clips.join(runs.select("run", (~F.col("version").eqNullSafe(F.lit(now))).alias("stale")), "run")
    return spread(of, "clip").withColumn("steps", aligned(F.col("ref"), F.col("hyp")))
