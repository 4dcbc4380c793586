"""Caller-supplied functions over many rows: block summaries and turn scores.

The function is called once per different request inside ``mapInPandas``; requests are dealt to small
tasks, and each task has a few calls in flight.  Results are written once before use, since a second
evaluation could answer differently.

With a ``journal`` (a folder every executor reaches) no answer is paid for twice: a task writes every
answer under the digest of its request as it comes and looks there before it calls, so a task that is
lost and run again, or the next job, goes on where the last one stopped.  When a job ends, its answers
are added to one table, which later jobs leave out by an anti join, and the single files are removed.
Only answers are kept; a call that failed is made again by the next job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.markers import section_summary
from chainloom.operators.storage import materialise

USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")

# What a turn score may say.
TURN_TYPES = (
    "file_read", "code_edit", "debug_attempt", "planning", "decision", "dead_end", "tool_query", "micro", "system_or_meta", "other",
)
IMPORTANCE = ("load_bearing", "supporting", "discardable")

ARTIFACT = (
    "STRUCT<kind: STRING, path: STRING, snippet_chars: BIGINT, what_changed_brief: STRING, name: STRING, "
    "args_brief: STRING, text: STRING, target: STRING>"
)
ARTIFACT_FIELDS = ("kind", "path", "snippet_chars", "what_changed_brief", "name", "args_brief", "text", "target")


CALLS_PER_TASK = 200  # what a lost task repeats at most


def _dealt(given: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as their number asks for; how many run at once is the cluster's matter."""
    given = materialise(given, "calls-due")
    return given.repartition(max(1, -(-given.count() // CALLS_PER_TASK)))


def _answers(fn: Callable[[tuple], list], rows: Iterator[tuple], concurrency: int) -> list[list]:
    """``fn`` of every row in order, ``concurrency`` at a time."""
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        return list(pool.map(fn, rows))


def request_digest(asked: str, *args: Column) -> Column:
    """What makes two requests the same: who is asked what.  Sizes keep neighbouring arguments apart."""
    fields = [F.coalesce(F.concat(F.length(a.cast("string")), F.lit(":"), a.cast("string")), F.lit("-")) for a in args]
    return F.sha2(F.concat(F.lit(asked), F.lit("|"), *fields), 256)


class Journal:
    """Answers by request digest below a shared folder: ``calls`` holds those of running jobs, ``answers`` all others."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, digest: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        return system, f"{root}/calls/{digest[:2]}/{digest}.json"

    def find(self, digest: str) -> str | None:
        system, path = self._at(digest)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as stream:
            return stream.read().decode()

    def keep(self, digest: str, answer: str) -> None:
        """Written aside and moved into place, so that a lost task leaves no half answer."""
        system, path = self._at(digest)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{time.time_ns()}"
        with system.open_output_stream(aside) as stream:
            stream.write(answer.encode())
        system.move(aside, path)

    def answered(self, requests: DataFrame) -> DataFrame:
        """(digest, answer) of the requests that earlier jobs have answers for."""
        schema = "digest string, answer string"
        try:
            known = requests.sparkSession.read.schema(schema).parquet(f"{self.folder}/answers")
        except AnalysisException:
            known = requests.sparkSession.createDataFrame([], schema)
        known = known.join(requests.select("digest"), "digest", "left_semi")
        return known.groupBy("digest").agg(F.min("answer").alias("answer"))  # two jobs at once may both have written one

    def add(self, answers: DataFrame) -> None:
        """Move the answers of a job into the table.  A job lost in between adds them again, to no effect."""
        answers.write.mode("append").parquet(f"{self.folder}/answers")

        def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for digest in batch["digest"]:
                    system, path = self._at(digest)
                    if system.get_file_info(path).type != fs.FileType.NotFound:
                        system.delete_file(path)
                yield batch[["digest"]].iloc[:0]

        answers.mapInPandas(drop, "digest string").count()


def _ask(requests: DataFrame, call: Callable[[tuple], tuple[Mapping | None, str | None]], label: str, concurrency: int, journal: str | None) -> DataFrame:
    """(digest, answer as JSON, error): one call for each different digest that the journal has no answer for."""
    kept = Journal(journal) if journal else None
    requests = materialise(requests.dropDuplicates(["digest"]), f"{label}-requests")
    due = requests
    if kept:
        known = materialise(kept.answered(requests), f"{label}-known").withColumn("error", F.lit(None).cast("string"))
        due = requests.join(known.select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(r) -> list:
            found = kept.find(r.digest) if kept else None
            if found is not None:
                return [r.digest, found, None]
            answer, error = call(r)
            text = None if answer is None else json.dumps(dict(answer))
            if kept and text is not None:
                kept.keep(r.digest, text)
            return [r.digest, text, error]

        for batch in batches:
            yield pd.DataFrame(_answers(one, batch.itertuples(index=False), concurrency), columns=["digest", "answer", "error"])

    fresh = materialise(_dealt(due).mapInPandas(run, "digest string, answer string, error string"), label)
    if not kept:
        return fresh
    kept.add(fresh.filter("answer IS NOT NULL").select("digest", "answer"))
    return fresh.unionByName(known)


class RateLimited(Exception):
    """Raised by a caller's function when the service asks to wait."""


def call_with_retry(fn: Callable, args: tuple, tries: int, wait: float, longest: float, sleep: Callable[[float], None] = time.sleep):
    """(answer, error): retry only on ``RateLimited``, doubling the wait."""
    for _ in range(tries):
        try:
            return fn(*args), None
        except RateLimited as e:
            error = f"rate-limited after retries: {e}"
            sleep(wait)
            wait = min(wait * 2, longest)
        except Exception as e:  # noqa: BLE001  any other failure becomes a row, not a failed job
            return None, str(e) or type(e).__name__
    return None, error


def _usage(answer: Mapping | None) -> list[int]:
    given = (answer or {}).get("usage") or {}
    return [int(given.get(k) or 0) for k in USAGE]


def summarize_blocks(
    targets: DataFrame, fn: Callable[[str, str, str], Mapping], *, concurrency: int = 5, tries: int = 4, wait: float = 1.0, longest: float = 30.0,
    journal: str | None = None, asked: str = "summary",
) -> DataFrame:
    """(conv, uuid, block_idx, summary, fallback, error, usage…) for targets with tool, args, content.

    ``fn(tool, args, content)`` returns {"summary": str, "usage": {...}}.  When it fails the
    section summary stands in.  Each task has ``concurrency`` calls in flight.  ``asked`` names the
    model and prompt behind ``fn`` in the journal.  Usage is that of the call behind the answer, so
    blocks with the same request, and answers from the journal, state what was paid once.
    """

    def call(r) -> tuple[Mapping | None, str | None]:
        return call_with_retry(fn, (r.tool, r.args, r.content), tries, wait, longest)

    request = request_digest(asked, F.col("tool"), F.col("args"), F.col("content"))
    given = targets.select("conv", "uuid", F.col("block_idx").cast("int").alias("block_idx"), "tool", "args", "content", request.alias("digest"))
    answers = _ask(given.select("digest", "tool", "args", "content"), call, "summaries", concurrency, journal)
    parsed = F.from_json("answer", f"summary string, usage struct<{', '.join(f'{u}: bigint' for u in USAGE)}>")
    answers = answers.select("digest", "error", parsed.alias("a"))
    rows = given.select("conv", "uuid", "block_idx", "digest", section_summary(F.col("content")).alias("heads")).join(answers, "digest")
    text = F.col("a.summary")
    error = F.when(text.isNotNull() | F.col("error").isNotNull(), F.col("error")).otherwise("no summary")
    usage = [F.coalesce(f"a.usage.{u}", F.lit(0)).alias(u) for u in USAGE]
    rows = rows.select("conv", "uuid", "block_idx", F.coalesce(text, "heads").alias("summary"), text.isNull().alias("fallback"), error.alias("error"), *usage)
    return materialise(rows, "summaries")


def usage_totals(answers: DataFrame) -> DataFrame:
    return answers.groupBy("conv").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(u).alias(u) for u in USAGE])


def check_score(answer: Mapping) -> str | None:
    """What is wrong with a score, or nothing."""
    if answer.get("type") not in TURN_TYPES:
        return f"bad type: {answer.get('type')}"
    if answer.get("importance") not in IMPORTANCE:
        return f"bad importance: {answer.get('importance')}"
    score = answer.get("value_score")
    if not isinstance(score, int) or isinstance(score, bool) or not 0 <= score <= 100:
        return f"bad value_score: {score}"
    if not isinstance(answer.get("summary"), str):
        return "summary missing"
    return None


def score_turns(
    skeletons: DataFrame, fn: Callable[[int, str], Mapping], *, concurrency: int = 5, tries: int = 7, wait: float = 2.0, longest: float = 60.0,
    journal: str | None = None, asked: str = "score",
) -> DataFrame:
    """turn_scores of ``skeletons(conv, turn_id, skeleton)``; a failed or malformed answer is a row with ``error``.

    ``asked`` names the model and prompt behind ``fn`` in the journal.
    """
    schema = (
        f"digest string, type string, summary string, key_artifacts array<{ARTIFACT}>, duplicate_signal string, "
        "lesson string, importance string, value_score int, error string, " + ", ".join(f"{u} bigint" for u in USAGE)
    )
    fields = ("type", "summary", "key_artifacts", "duplicate_signal", "lesson", "importance", "value_score")

    def call(r) -> tuple[Mapping | None, str | None]:
        return call_with_retry(fn, (int(r.turn_id), r.skeleton), tries, wait, longest)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(r) -> list:
            answer = json.loads(r.answer) if r.answer else {}
            error = r.error or check_score(answer)
            kept = {} if error else dict(answer)
            if kept:
                kept["key_artifacts"] = [{k: a.get(k) for k in ARTIFACT_FIELDS} for a in kept.get("key_artifacts") or []]
            return [r.digest, *[kept.get(f) for f in fields], error, *_usage(answer)]

        for batch in batches:
            out = pd.DataFrame([one(r) for r in batch.itertuples(index=False)], columns=["digest", *fields, "error", *USAGE])
            out["value_score"] = out["value_score"].astype("Int32")
            yield out

    request = request_digest(asked, F.col("turn_id"), F.col("skeleton"))
    given = skeletons.select("conv", F.col("turn_id").cast("bigint").alias("turn_id"), "skeleton", request.alias("digest"))
    answers = _ask(given.select("digest", "turn_id", "skeleton"), call, "turn-answers", concurrency, journal).mapInPandas(check, schema)
    return materialise(given.select("conv", "turn_id", "digest").join(answers, "digest").drop("digest"), "turn-scores")
