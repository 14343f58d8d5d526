"""Asking a judge about candidate pairs, in batches, and acting on its answers.

A judge is any function that takes a pandas frame of questions (column ``prompt`` plus the keys of the question) and
returns one raw response, or None, per row; one with a second argument also gets the request options. It runs inside ``mapInPandas``; prompts, truncation and parsing around it
are column expressions. Every frame of answers is written to a table before it is used again, since a second
evaluation would ask the judge a second time.
"""

from __future__ import annotations

import inspect
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.functions.parse import comparing_answer, parse
from twinlink.functions.prompts import build_prompt, prompt_filler, prompt_group, selecting_prompt
from twinlink.functions.text import TAIL_TOKENS, once, truncate_text, truncate_tokens
from twinlink.operators.rank import LIST_ROWS, rank_within
from twinlink.operators.registry import check_prompt_mode
from twinlink.schema import COMPARING, FAILED, MATCHING, REASONING_MODEL, SELECTING, VALID
from twinlink.session import materialise

Judge = Callable[[pd.DataFrame], Sequence[str | None]]


#: A judge raises one of these when a request does not come through; any other exception is a fault and ends the job.
class RequestFailed(Exception):
    """For judges whose own errors are no ``OSError``."""


RETRIED = (OSError, RequestFailed)
#: Single questions that are tried before a batch whose halves both fail is given up as an outage.
PROBES = 3
# A list with more candidates than this is sorted in rounds over all tasks instead of inside one.
LONG_LIST = 10_000
# Questions for which a sort has one task at least; beside ``spark.sql.shuffle.partitions`` it sets the number of tasks.
TASK_QUESTIONS = 500_000
# Responses up to so many characters are read once in a task; so many of them are remembered.
SHORT_RESPONSE, READ_RESPONSES = 64, 4096
# Answer lengths that the request options ask for.
ANSWER_TOKENS, THINKING_TOKENS = 128, 8192


@dataclass(frozen=True)
class Options:
    """How questions are put: prompt size, request options, retries, and whether answers carry a chain of thought."""

    model: str = "judge"
    run_id: str = "run"
    max_tokens: int = 2048
    attempts: int = 3
    retry_wait: float = 5.0
    think: bool = True
    temperature: float = 0.0
    # Questions sent in one call.
    batch_rows: int = 1024
    # Batches without any answer after which a task asks nothing more.
    outage_batches: int = 3
    # Candidate pairs that are judged between two commits of a run.
    commit_pairs: int = 200_000
    # Failed lists or pairs that a run puts up with.
    failure_limit: int = 1000

    @property
    def flags(self) -> dict[str, bool]:
        return {"reasoning": self.model == REASONING_MODEL, "think": self.think}

    @property
    def num_predict(self) -> int:
        """Answer length to allow: a reasoning model needs room for its thoughts."""
        return THINKING_TOKENS if self.model == REASONING_MODEL else ANSWER_TOKENS

    @property
    def request(self) -> dict[str, object]:
        """What a judge that takes a second argument is told about the request."""
        return {
            "model": self.model, "temperature": self.temperature, "num_predict": self.num_predict,
            "num_ctx": self.max_tokens, "think": self.think,
        }


def _put(judge: Judge, options: Options | None) -> Judge:
    """The judge with the request options bound to its second argument, if it has one."""
    try:
        takes = len([p for p in inspect.signature(judge).parameters.values() if p.default is p.empty and p.kind <= p.POSITIONAL_OR_KEYWORD])
    except (TypeError, ValueError):
        takes = 1
    if options is None or takes < 2:
        return judge
    return lambda questions: judge(questions, options.request)


def _tried(judge: Judge, questions: pd.DataFrame, attempts: int, wait: float) -> list[str | None] | None:
    """The responses, or None if every attempt failed; the pause grows by ``wait`` seconds with every failure."""
    for i in range(attempts):
        try:
            responses = list(judge(questions))
        except RETRIED:
            time.sleep(wait * i)
            continue
        if len(responses) != len(questions):
            raise ValueError("a judge must return one response per question")
        return responses
    return None


def ask_apart(judge: Judge, questions: pd.DataFrame, attempts: int, wait: float) -> tuple[list[str | None], list[bool]]:
    """Responses in row order, and which questions failed.

    A failing batch is halved until the failure is pinned to single questions, so the others keep their answers. If
    both halves fail and so do a few single questions of them, the judge is out of reach and all questions fail.
    """
    n = len(questions)
    if not n:
        return [], []
    responses = _tried(judge, questions, attempts, wait)
    if responses is not None:
        return responses, [False] * n
    return _halved(judge, questions, attempts, wait)


def _halved(judge: Judge, questions: pd.DataFrame, attempts: int, wait: float) -> tuple[list[str | None], list[bool]]:
    n = len(questions)
    if n == 1:
        return [None], [True]
    halves = [questions.iloc[: n // 2], questions.iloc[n // 2 :]]
    tried = [_tried(judge, half, attempts, wait) for half in halves]
    if all(t is None for t in tried) and n > PROBES:
        probes = sorted({0, n // 2, n - 1})[:PROBES]
        if all(_tried(judge, questions.iloc[k : k + 1], attempts, wait) is None for k in probes):
            return [None] * n, [True] * n
    responses: list[str | None] = []
    failed: list[bool] = []
    for half, found in zip(halves, tried):
        more = (found, [False] * len(half)) if found is not None else _halved(judge, half, attempts, wait)
        responses += more[0]
        failed += more[1]
    return responses, failed


def ask_with_retry(judge: Judge, questions: pd.DataFrame, attempts: int, wait: float) -> list[str | None]:
    """Responses in row order; a question that keeps failing gets None."""
    return ask_apart(judge, questions, attempts, wait)[0]


class Line:
    """One task's line to the judge. After ``outage_batches`` batches without any answer it is closed: what is still
    to be asked fails at once, so that the task ends and what others answered can be kept."""

    def __init__(self, judge: Judge, options: Options):
        self.judge, self.options, self.silent = _put(judge, options), options, 0

    def put(self, questions: pd.DataFrame) -> tuple[list[str | None], list[bool], np.ndarray]:
        """Response of each question, whether it failed, and when (UTC) it came back, sent in calls of ``batch_rows``."""
        responses, failed, times = [], [], [np.zeros(0, dtype="datetime64[ns]")]
        for at in range(0, len(questions), self.options.batch_rows):
            part = questions.iloc[at : at + self.options.batch_rows]
            if self.silent < self.options.outage_batches:
                found, lost = ask_apart(self.judge, part, self.options.attempts, self.options.retry_wait)
                self.silent = self.silent + 1 if all(lost) else 0
            else:
                found, lost = [None] * len(part), [True] * len(part)
            responses += found
            failed += lost
            times.append(np.full(len(part), pd.Timestamp.now(tz="UTC").to_datetime64(), dtype="datetime64[ns]"))
        return responses, failed, np.concatenate(times)

    def ask(self, questions: pd.DataFrame) -> pd.DataFrame:
        """``response``, ``failed`` and ``answered_at`` of each question."""
        responses, failed, times = self.put(questions)
        times = pd.Series(times).dt.tz_localize("UTC")
        return pd.DataFrame({"response": pd.Series(responses, dtype=object), "failed": failed, "answered_at": times})


_ANSWER = [
    T.StructField("response", T.StringType()), T.StructField("failed", T.BooleanType()), T.StructField("answered_at", T.TimestampType()),
]


def judge_retry(questions: DataFrame, judge: Judge, options: Options, drop: Sequence[str] = ()) -> DataFrame:
    """Add the judge's raw ``response`` to every question, whether the request ``failed``, and when it came back.

    The response is null where the judge gave none and where the request failed; only the latter is asked again.
    Columns to ``drop`` are shown to the judge and not sent back.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line = Line(judge, options)
        for frame in frames:
            for at in range(0, len(frame), options.batch_rows):
                part = frame.iloc[at : at + options.batch_rows].reset_index(drop=True)
                yield pd.concat([part.drop(columns=list(drop)), line.ask(part)], axis=1)

    return questions.mapInPandas(run, T.StructType([f for f in questions.schema.fields if f.name not in drop] + _ANSWER))


class Asker:
    """One prompt type put to one judge; its column expressions are built once and serve any number of frames."""

    def __init__(self, judge: Judge, prompt_type: str, options: Options):
        self.judge, self.options = judge, options
        self.full_prompt = build_prompt(prompt_type, "record", "candidates").alias("full_prompt")
        self.prompt = truncate_tokens("full_prompt", options.max_tokens).alias("prompt")
        self.size = F.size("candidates").alias("n_candidates")
        self.parsed = parse(prompt_type, "response", "n_candidates", **options.flags)
        self.status = F.when(F.col("failed"), FAILED).otherwise(F.col("parsed.status")).alias("status")

    def __call__(self, questions: DataFrame) -> DataFrame:
        keys = [c for c in questions.columns if c not in ("record", "candidates")]
        return self.send(questions.select(*keys, self.size, self.full_prompt), keys)

    def send(self, written: DataFrame, keys: list[str]) -> DataFrame:
        """Ask what is written out in ``full_prompt``, about ``n_candidates`` candidates."""
        asked = written.select(*keys, "n_candidates", self.prompt)
        responses = judge_retry(asked, self.judge, self.options, drop=["prompt"])
        parsed = responses.withColumn("parsed", self.parsed)
        return parsed.select(*keys, self.status, "parsed.answer", "answered_at")


def judge_batch(questions: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """Ask about ``record`` and its ``candidates``; adds ``status``, ``answer`` and ``answered_at``, drops the texts."""
    return Asker(judge, prompt_type, options)(questions)


def log_rows(answers: DataFrame, prompt_type: str, options: Options) -> DataFrame:
    """Answers ``(d1_id, d2_candidates_id, result, status, answered_at)`` in the layout of the result log.

    Rows whose request failed have that status; they are for the caller to see, not for the log (``final_rows``).
    """
    return answers.select(
        F.col("d1_id").cast("string").alias("d1_id"),
        F.col("d2_candidates_id").cast("array<string>").alias("d2_candidates_id"),
        F.col("result").cast("string").alias("result"),
        F.col("status").alias("request_status"),
        F.coalesce("answered_at", F.current_timestamp()).alias("inserted_at"),
        F.lit(prompt_type).alias("prompt_type"),
        F.lit(prompt_group(prompt_type)).alias("prompt_group"),
        F.lit(options.model).alias("model"),
        F.lit(options.run_id).alias("run_id"),
    )


def final_rows(rows: DataFrame) -> DataFrame:
    """The log rows that say something final."""
    return rows.filter(F.col("request_status") != FAILED)


def match_answers(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """``(d1_id, pos, d2_id, status, answer)`` for pairs with texts, asked one by one."""
    questions = pairs.select(
        "d1_id", "pos", "d2_id", F.col("d1_text").alias("record"), F.array("d2_text").alias("candidates")
    )
    return judge_batch(questions, judge, prompt_type, options)


def match_pairs(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """Log rows of the matching mode: the d2 record when the judge says yes, else null."""
    check_prompt_mode(MATCHING, prompt_type)
    answers = match_answers(pairs, judge, prompt_type, options)
    rows = answers.select(
        "d1_id",
        F.array("d2_id").alias("d2_candidates_id"),
        F.when(F.col("answer") == "yes", F.col("d2_id")).alias("result"),
        "status",
        "answered_at",
    )
    return log_rows(rows, prompt_type, options)


def _numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with their ``slot`` in the d1's list, from 0, and the list's length ``n``."""
    sizes = pairs.groupBy("d1_id").agg(F.count("*").alias("n"))
    ranked = rank_within(pairs, ["d1_id"], [F.col("pos"), F.col("d2_id")], sizes=pairs)
    slots = ranked.withColumn("slot", F.col("rank") - 1).drop("rank", "pos")
    return slots.join(sizes, "d1_id").withColumns({"status": F.lit(VALID), "answered_at": F.lit(None).cast("timestamp")})


def compare_sort(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options, long_list: int = LONG_LIST) -> DataFrame:
    """Bubble-sort every d1's candidates by a pairwise judge: ``(d1_id, slot, d2_id, status, texts...)``, best at 0.

    A comparison asks about slots (i + 1, i) as records A and B and swaps them on a valid "record a". Its outcome
    only depends on the neighbouring comparisons of this pass and the one before, so comparison i of pass p can run
    in round i + 2p next to all others of that round. A list of n is sorted in 2n - 3 rounds with the questions, and
    therefore the result, of the sequential sort, whether or not the judge is transitive.

    A list is sorted inside one task, which steps as many lists together as fill a call of ``batch_rows`` questions;
    so the number of jobs does not depend on the lists. Lists of more than ``long_list`` candidates, with their
    ``n * n / 2`` questions, go through the rounds as one row per candidate spread over all tasks.

    ``status`` at slot 0 is that of the last question; a list of one is valid without a question. A list with a
    question that failed has that status and is not sorted any further. ``answered_at`` is the time of the last answer.
    """
    short, long, questions = _by_size(pairs, long_list)
    lists = sorted_lists(short, judge, prompt_type, options, questions)
    row = F.posexplode(F.arrays_zip("d2_ids", "d2_texts")).alias("slot", "row")
    out = lists.select("d1_id", "d1_text", "status", "answered_at", row)
    out = out.select("d1_id", "slot", F.col("row.d2_ids").alias("d2_id"), "d1_text", F.col("row.d2_texts").alias("d2_text"), "status", "answered_at")
    return out if long is None else out.unionByName(_sorted_in_rounds(long, judge, prompt_type, options))


def _questions(n: Column) -> Column:
    """Comparisons that sort a list of ``n``."""
    return n.cast("double") * (n - 1) / 2


def _by_size(pairs: DataFrame, long_list: int) -> tuple[DataFrame, DataFrame | None, float]:
    """The pairs of lists that one task sorts, those of longer ones if there are any, and the questions of the former."""
    pairs = pairs.select("d1_id", "pos", "d2_id", "d1_text", "d2_text")
    sizes = pairs.groupBy("d1_id").agg(F.count("*").alias("n"))
    short = F.col("n") <= long_list
    most = sizes.agg(F.max("n").alias("n"), F.sum(F.when(short, _questions(F.col("n")))).alias("questions")).first()
    if (most.n or 0) <= long_list:
        return pairs, None, most.questions or 0
    long = sizes.filter(~short).select("d1_id")
    return pairs.join(long, "d1_id", "left_anti"), pairs.join(long, "d1_id", "left_semi"), most.questions or 0


def sorted_lists(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options, questions: float = 0) -> DataFrame:
    """The sorted lists as rows ``(d1_id, d1_text, d2_ids, d2_texts, status, answered_at)``, each sorted in one task.

    ``questions`` is how many the lists take together; tasks grow in number with them, not in length.
    """
    # A fixed number of partitions is not coalesced: each of them is a line to the judge. They are dealt by a hash of the
    # key: pairs that a join has dealt into as many by the key itself would not be dealt again, and that join's are coalesced.
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(questions / TASK_QUESTIONS))
    pairs = pairs.select("d1_id", "pos", "d2_id", "d1_text", "d2_text")
    lists = pairs.repartition(parts, F.xxhash64("d1_id")).sortWithinPartitions("d1_id", "pos", "d2_id")
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType(
        [
            T.StructField("d1_id", kinds["d1_id"]), T.StructField("d1_text", T.StringType()),
            T.StructField("d2_ids", T.ArrayType(kinds["d2_id"])), T.StructField("d2_texts", T.ArrayType(T.StringType())),
            T.StructField("status", T.StringType()), T.StructField("answered_at", T.TimestampType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _sort_together(frames, Line(judge, options), prompt_type, options)

    # A table: a second evaluation would ask the judge again.
    return materialise(lists.mapInPandas(run, schema))


class _Sorts:
    """Lists in the middle of their sorts: their rows one after the other, and where each list stands and begins."""

    def __init__(self, frame: pd.DataFrame):
        owners = frame["d1_id"].to_numpy()
        self.ids, self.texts = frame["d2_id"].to_numpy(copy=True), frame["d2_text"].to_numpy(dtype=object, copy=True)
        self.start = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]][: len(frame)])
        self.n = np.diff(np.r_[self.start, len(frame)])
        last = self.start + self.n - 1
        self.d1_id, self.d1_text = owners[last], frame["d1_text"].to_numpy(dtype=object)[last]
        self.t = np.zeros(len(self.n), dtype=np.int64)
        self.status = np.full(len(self.n), VALID, dtype=object)
        self.at = np.full(len(self.n), np.datetime64("NaT"), dtype="datetime64[ns]")

    def rows(self, lists: np.ndarray) -> np.ndarray:
        """Places of all rows of the lists."""
        return _spread(self.start[lists], self.n[lists])

    def add(self, other: _Sorts, lists: np.ndarray) -> None:
        """Append lists of another object."""
        rows, n = other.rows(lists), other.n[lists]
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(n) - n]
        self.ids, self.texts = np.concatenate([self.ids, other.ids[rows]]), np.concatenate([self.texts, other.texts[rows]])
        for name in ("n", "d1_id", "d1_text", "t", "status", "at"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)[lists]]))

    def pending(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first slot that is compared with its next one in the round at hand, and the number of comparisons, two slots apart."""
        t, n = self.t[lists], self.n[lists]
        lowest = t % 2
        return lowest, (np.minimum(t, 2 * n - 4 - t) - lowest) // 2 + 1

    def out(self, lists: np.ndarray) -> pd.DataFrame:
        ends = [slice(at, at + n) for at, n in zip(self.start[lists].tolist(), self.n[lists].tolist())]
        rows = {
            "d1_id": self.d1_id[lists], "d1_text": self.d1_text[lists], "d2_ids": [self.ids[e].tolist() for e in ends],
            "d2_texts": [self.texts[e].tolist() for e in ends], "status": self.status[lists],
            "answered_at": pd.Series(self.at[lists]).dt.tz_localize("UTC"),
        }
        return pd.DataFrame(rows)


def _spread(start: np.ndarray, n: np.ndarray, step: int = 1) -> np.ndarray:
    """``start, start + step, ...``, ``n`` of them, for each element one after the other."""
    return np.repeat(start, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _whole_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that are sorted by d1, cut anew so that no list runs over an end."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        owners = frame["d1_id"].to_numpy()
        changes = np.flatnonzero(owners[1:] != owners[:-1])
        cut = changes[-1] + 1 if len(changes) else 0
        if cut:
            yield frame.iloc[:cut]
        rest = frame.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _sort_together(frames: Iterator[pd.DataFrame], line: Line, prompt_type: str, options: Options) -> Iterator[pd.DataFrame]:
    """Sorted lists; those at work are stepped by numpy, one round each in a turn, and others join while a call has room."""
    fill, known = prompt_filler(prompt_type), {}

    def outcome(response: str | None, failed: bool) -> tuple[str, bool]:
        """Status of an answer, and whether the two rows change places."""
        if failed:
            return FAILED, False
        found = known.get(response)
        if found is None:
            status, answer = comparing_answer(response, **options.flags)
            found = status, status == VALID and answer == "record a"
            if response is None or len(response) <= SHORT_RESPONSE:
                if len(known) >= READ_RESPONSES:
                    known.clear()
                known[response] = found
        return found

    waiting, lists, done = _whole_lists(frames), None, []
    active, fresh = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    more = True
    while more or len(fresh) or len(active):
        first, count = lists.pending(active) if len(active) else (active, active)
        while (room := options.batch_rows - int(count.sum())) > 0 and (more or len(fresh)):
            if not len(fresh):
                frame = next(waiting, None)
                more = frame is not None
                if not more:
                    break
                loaded = _Sorts(frame)
                done.append(loaded.out(np.flatnonzero(loaded.n == 1)))
                fresh = np.flatnonzero(loaded.n > 1) + len(active)
                if len(active):
                    kept, loaded = loaded, _Sorts(frame.iloc[:0])
                    loaded.add(lists, active)
                    loaded.add(kept, np.arange(len(kept.n)))
                lists, active = loaded, np.arange(len(active))
                continue
            # The first round of a list is one comparison.
            active, fresh = np.r_[active, fresh[:room]], fresh[room:]
            first, count = lists.pending(active)
        if not len(active):
            continue
        owner = np.repeat(active, count)
        b = _spread(lists.start[active] + first, count, 2)
        a = b + 1
        texts = lists.d1_text[owner], lists.texts[a], lists.texts[b]
        asked = {
            "d1_id": lists.d1_id[owner], "d1_text": texts[0], "a_id": lists.ids[a], "a_text": texts[1],
            "b_id": lists.ids[b], "b_text": texts[2], "n_candidates": 2,
            "prompt": np.array([truncate_text(text, options.max_tokens) for text in map(fill, *texts)], dtype=object),
        }
        responses, failed, times = line.put(pd.DataFrame(asked))
        outcomes, last = list(map(outcome, responses, failed)), np.cumsum(count) - 1
        swap = np.fromiter((changes for _, changes in outcomes), dtype=bool, count=len(outcomes))
        lists.status[active] = [outcomes[k][0] for k in last.tolist()]
        lists.at[active] = times[last]
        lists.t[active] += 1
        ended = lists.t[active] > 2 * lists.n[active] - 4
        if any(failed):
            # A list ends with its first question that failed; what was asked behind it changes nothing.
            before = np.cumsum(failed)
            lost = before - np.repeat(before[last - count + 1] - np.array(failed)[last - count + 1], count) > 0
            swap &= ~lost
            lists.status[active[lost[last]]] = FAILED
            ended |= lost[last]
        a, b = a[swap], b[swap]
        for column in (lists.ids, lists.texts):
            column[a], column[b] = column[b], column[a]
        if ended.any():
            done.append(lists.out(active[ended]))
            active = active[~ended]
        if sum(map(len, done)) >= options.batch_rows:
            yield pd.concat(done)
            done = []
    if done:
        yield pd.concat(done)


def _sorted_in_rounds(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """``compare_sort`` of lists too long for one task: each round is a table of one row per candidate."""
    state = materialise(_numbered(pairs))
    longest = state.agg(F.max("n")).first()[0] or 0
    done = [state.filter(F.col("n") == 1)]
    columns = state.columns
    compare = _Round(Asker(judge, prompt_type, options))
    for t in range(max(0, 2 * longest - 3)):
        state = materialise(compare(state.filter(f"2 * n - 3 > {t}"), t))
        # Lists of n candidates have had their last question in round 2n - 4.
        done.append(state.filter(f"2 * n - 4 = {t}"))
    out = done[0].select(*columns)
    for part in done[1:]:
        out = out.unionByName(part)
    # A question that failed in any round makes the whole list fail.
    lost = out.groupBy("d1_id").agg(F.max(F.col("status") == FAILED).alias("lost"))
    status = F.when(F.col("lost"), FAILED).otherwise(F.col("status"))
    return out.drop("n").join(lost, "d1_id").withColumn("status", status).drop("lost")


class _Round:
    """One round of comparisons; the expressions are built once, the round number is a column."""

    def __init__(self, ask: Asker):
        self.ask = ask
        slot, t, n, lower = F.col("slot"), F.col("t"), F.col("n"), F.col("lower")
        self.lower = F.when((t - slot) % 2 == 0, slot).otherwise(slot - 1)
        self.meets = (lower >= 0) & (lower <= t) & (lower + (t - lower) / 2 <= n - 2)

        def at(offset: int):
            here = F.when(slot == lower + offset, F.struct("d2_id", "d2_text"))
            return F.max(here)

        self.meeting = [F.first("n").alias("n"), F.first("d1_text").alias("d1_text"), at(1).alias("a"), at(0).alias("b")]
        names = {"a.d2_id": "a_id", "a.d2_text": "a_text", "b.d2_id": "b_id", "b.d2_text": "b_text", "d1_text": "record"}
        self.question = [F.col(c).alias(name) for c, name in names.items()]
        self.question.append(F.array("a.d2_text", "b.d2_text").alias("candidates"))

        swap = F.coalesce((F.col("status") == VALID) & (F.col("answer") == "record a"), F.lit(False))

        def moved(side: str, up, down):
            place = F.when(swap, up).otherwise(down)
            return F.struct(place.alias("slot"), F.col(f"{side}_id").alias("d2_id"), F.col(f"{side}_text").alias("d2_text"))

        self.moved = F.explode(F.array(moved("a", lower, lower + 1), moved("b", lower + 1, lower))).alias("row")

    def __call__(self, state: DataFrame, t: int) -> DataFrame:
        marked = state.withColumn("t", F.lit(t)).withColumn("lower", self.lower).withColumn("meets", self.meets)
        pairs = marked.filter("meets").groupBy("d1_id", "lower").agg(*self.meeting)
        judged = self.ask(pairs.select("d1_id", "lower", "n", "d1_text", *self.question))
        kept = ["d1_id", "n", "d1_text", "status", "answered_at"]
        moved = judged.select(*kept, self.moved).select(*kept, "row.*")
        return moved.unionByName(marked.filter("not meets").select(*moved.columns))


def score_sort(pairs: DataFrame, score: str) -> DataFrame:
    """What ``compare_sort`` gives when the judge prefers the larger score: a stable sort, best at slot 0."""
    ranked = rank_within(pairs, ["d1_id"], [F.col(score).desc(), F.col("pos"), F.col("d2_id")], sizes=pairs)
    return ranked.withColumn("slot", F.col("rank") - 1).drop("rank")


def _log_lists(outcomes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Outcomes ``(d1_id, result, status, answered_at)`` with their ordered candidates, as the result log holds them.

    A list longer than ``LIST_ROWS`` goes on in further rows of the same d1, which assert nothing; neither resuming
    nor the metrics see a difference.
    """
    rows = F.array_sort(F.collect_list(F.struct("slot", "d2_id")))
    lists = (
        ordered.withColumn("part", F.floor(F.col("slot") / LIST_ROWS))
        .groupBy("d1_id", "part")
        .agg(rows.alias("rows"))
        .select("d1_id", "part", F.col("rows.d2_id").alias("ids"))
    )
    first = F.coalesce(F.col("part") == 0, F.lit(True))
    return outcomes.join(lists, "d1_id", "left").select(
        "d1_id",
        F.coalesce("ids", F.array().cast(lists.schema["ids"].dataType)).alias("d2_candidates_id"),
        F.when(first, F.col("result")).alias("result"),
        "status",
        "answered_at",
    )


def compare_pick(pairs: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """Log rows of the comparing mode: the whole order, its first element as the result."""
    check_prompt_mode(COMPARING, prompt_type)
    short, long, questions = _by_size(pairs, LONG_LIST)
    lists = sorted_lists(short, judge, prompt_type, options, questions)
    rows = _list_parts(lists.select("d1_id", F.get("d2_ids", F.lit(0)).alias("result"), "status", "answered_at", "d2_ids"))
    if long is not None:
        ordered = materialise(_sorted_in_rounds(long, judge, prompt_type, options))
        best = ordered.filter("slot = 0").select("d1_id", F.col("d2_id").alias("result"), "status", "answered_at")
        rows = rows.unionByName(_log_lists(best, ordered))
    return log_rows(rows, prompt_type, options)


def _list_parts(lists: DataFrame) -> DataFrame:
    """``_log_lists`` of lists that are arrays already."""
    last = F.greatest(F.ceil(F.size("d2_ids") / F.lit(LIST_ROWS)).cast("int") - 1, F.lit(0))
    parts = lists.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return parts.select(
        "d1_id",
        F.slice("d2_ids", F.col("part") * LIST_ROWS + 1, F.lit(LIST_ROWS)).alias("d2_candidates_id"),
        F.when(F.col("part") == 0, F.col("result")).alias("result"),
        "status",
        "answered_at",
    )


def _selecting_questions(ordered: DataFrame, max_tokens: int) -> DataFrame:
    """One prompt per d1 over its sorted candidates.

    Truncation keeps fewer than ``max_tokens`` tokens at the start and ``TAIL_TOKENS`` at the end, and every line has
    a token. Of a longer list the lines between are therefore left out before they are gathered: the truncated
    prompt is the same, and no row grows with the list.
    """
    sizes = ordered.groupBy("d1_id").agg(F.count("*").cast("int").alias("n_candidates"))
    seen = (F.col("slot") < max_tokens) | (F.col("slot") >= F.col("n_candidates") - TAIL_TOKENS)
    rows = F.array_sort(F.collect_list(F.struct("slot", "d2_text")))
    lists = (
        ordered.join(sizes, "d1_id")
        .filter(seen)
        .groupBy("d1_id", "n_candidates")
        .agg(F.first("d1_text").alias("record"), rows.alias("rows"))
    )
    numbers = F.transform("rows.slot", lambda s: s + 1)
    return lists.select(
        "d1_id", "n_candidates", selecting_prompt("record", "rows.d2_text", numbers).alias("full_prompt")
    )


def select_cascade(
    pairs: DataFrame,
    judge: Judge,
    prompt_type: str,
    options: Options,
    matching: str = "MATCHING_PROMPT_ONLY",
    comparing: str = "COMPARING_PROMPT",
) -> DataFrame:
    """Log rows of the selecting mode.

    Every candidate is matched first; the accepted ones are sorted by comparisons; the judge then picks a number
    from the sorted list, where 0 means none of them. A d1 without an accepted candidate is answered without asking.
    A d1 with a question that failed in any of the three steps has that status.
    """
    check_prompt_mode(SELECTING, prompt_type)
    select = Asker(judge, prompt_type, options)
    texts = pairs.select(
        "d1_id", "pos", "d2_id", "d1_text", "d2_text", F.col("d1_text").alias("record"), F.array("d2_text").alias("candidates")
    )
    answers = judge_batch(texts, judge, matching, options)
    yes = F.coalesce((F.col("status") == VALID) & (F.col("answer") == "yes"), F.lit(False))
    # The texts of accepted candidates stay with their answers, so nothing is joined back.
    matched = materialise(
        answers.select(
            "d1_id", "pos", "d2_id", "status", "answered_at", yes.alias("accepted"),
            F.when(yes, F.col("d1_text")).alias("d1_text"), F.when(yes, F.col("d2_text")).alias("d2_text"),
        )
    )
    seen = matched.groupBy("d1_id").agg(
        F.max(F.col("status") == FAILED).alias("lost"), F.max("answered_at").alias("matched_at"), F.count_if("accepted").alias("n")
    )
    # One look at the sizes spares most runs the joins that set lists apart.
    most = seen.agg(F.max("lost").alias("lost"), F.max("n").alias("n"), F.sum(_questions(F.col("n"))).alias("questions")).first()
    whole = matched.filter("accepted")
    if most.lost:
        whole = whole.join(seen.filter("lost"), "d1_id", "left_anti")
    short, long, questions = _by_size(whole, LONG_LIST) if (most.n or 0) > LONG_LIST else (whole, None, most.questions or 0)
    seen = seen.drop("n")
    lists = sorted_lists(short, judge, comparing, options, questions)
    asked = lists.filter(F.col("status") != FAILED).select(
        "d1_id", "d2_ids", F.size("d2_ids").alias("n_candidates"), _selecting_prompt("d1_text", "d2_texts", options.max_tokens).alias("full_prompt")
    )
    number = F.when(F.col("status") == VALID, F.col("answer").cast("int"))
    chosen = select.send(asked, ["d1_id", "d2_ids"])
    chosen = chosen.select("d1_id", "d2_ids", F.get("d2_ids", number - 1).alias("result"), "status", "answered_at")
    lost = lists.filter(F.col("status") == FAILED).select("d1_id", "d2_ids", F.lit(None).cast(pairs.schema["d2_id"].dataType).alias("result"), "status", "answered_at")
    chosen = materialise(chosen).unionByName(lost)
    rows = _list_parts(_outcomes(seen, chosen).withColumn("d2_ids", F.coalesce("d2_ids", F.array().cast(chosen.schema["d2_ids"].dataType))))
    if long is not None:
        hot = long.select("d1_id").distinct()
        rows = rows.join(hot, "d1_id", "left_anti").unionByName(_select_long(seen.join(hot, "d1_id", "left_semi"), long, select, judge, comparing, options))
    return log_rows(rows, prompt_type, options)


def _outcomes(seen: DataFrame, chosen: DataFrame) -> DataFrame:
    """What became of every d1: chosen from a list, nothing to choose from, or failed on the way."""
    status = F.when(F.col("lost"), FAILED).otherwise(F.coalesce("status", F.lit(VALID)))
    both = seen.join(chosen, "d1_id", "left").withColumn("status", status)
    return both.withColumn("answered_at", F.coalesce("answered_at", "matched_at")).drop("lost", "matched_at")


def _selecting_prompt(record: str, texts: str, max_tokens: int) -> Column:
    """The selecting prompt over an array, without the lines that truncation drops anyway (``_selecting_questions``)."""
    n = F.size(texts)
    numbered = F.transform(texts, lambda t, i: F.struct((i + 1).alias("number"), t.alias("text")))
    seen = F.filter(numbered, lambda r: (r["number"] <= max_tokens) | (r["number"] > n - TAIL_TOKENS))
    return once(seen, lambda rows: selecting_prompt(record, rows["text"], rows["number"]))


def _select_long(seen: DataFrame, pairs: DataFrame, select: Asker, judge: Judge, comparing: str, options: Options) -> DataFrame:
    """The end of the cascade for lists too long for one row."""
    ordered = materialise(_sorted_in_rounds(pairs, judge, comparing, options))
    sorted_ = ordered.filter(F.col("status") != FAILED)
    chosen = materialise(select.send(_selecting_questions(sorted_, options.max_tokens), ["d1_id"]))
    number = F.when(F.col("status") == VALID, F.col("answer").cast("int"))
    picked = chosen.withColumn("slot", number - 1).join(
        sorted_.select("d1_id", "slot", F.col("d2_id").alias("result")), ["d1_id", "slot"], "left"
    )
    unsorted = ordered.filter((F.col("slot") == 0) & (F.col("status") == FAILED))
    unsorted = unsorted.select("d1_id", F.lit(None).cast(ordered.schema["d2_id"].dataType).alias("result"), "status", "answered_at")
    return _log_lists(_outcomes(seen, picked.select("d1_id", "result", "status", "answered_at").unionByName(unsorted)), ordered)


def run_mode(mode: str, pairs: DataFrame, judge: Judge, prompt_type: str, options: Options) -> DataFrame:
    """Log rows of one mode over pairs with texts."""
    modes = {MATCHING: match_pairs, COMPARING: compare_pick, SELECTING: select_cascade}
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode}")
    return modes[mode](pairs, judge, prompt_type, options)
