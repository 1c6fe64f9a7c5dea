"""Apply a user-supplied model to a text column.

A provider is ``provider(inputs: list[str], **options) -> list``.  Each answer is
a string (or a list of floats for an embedding), or a ``(answer, rating)`` pair
where ``rating`` is JSON text about the answer's safety.  It runs inside tasks on
Arrow batches, so Spark spreads the calls over the executors; only the input
column crosses to Python, the others stay where they are.

All of this is lazy: no job runs while a plan is built, and each action asks.  Answers
that several consumers share, or that later runs should find, go to an ``AnswerStore``.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import voxcart
from pyspark import Accumulator, TaskContext, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

Provider = Callable[..., list]

# Send the task code along with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(voxcart)

# The names model functions give their result columns, and the
# status of a row that has no input.
RESULT, RATING, STATUS = (
    "ml_generate_text_llm_result",
    "ml_generate_text_rai_result",
    "ml_generate_text_status",
)
NULL_INPUT, NOT_ASKED = "null_input", "not_asked"
# The functions below take all batches of a task, one after another.
_PER_BATCH = PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


@dataclass(frozen=True)
class CallControl:
    """How a task calls: seconds for one call, tries after the first, and pauses between them.

    A pause doubles with each try.  ``counts`` may hold accumulators of the session under
    ``calls``, ``inputs``, ``retries`` and ``timeouts``.
    """

    timeout: float | None = None
    retries: int = 0
    backoff: float = 0.5
    counts: dict[str, Accumulator] = field(default_factory=dict)

    @classmethod
    def counting(cls, spark: SparkSession, **settings: Any) -> CallControl:
        names = ("calls", "inputs", "retries", "timeouts")
        return cls(counts={n: spark.sparkContext.accumulator(0) for n in names}, **settings)

    def count(self, name: str, n: int = 1) -> None:
        if name in self.counts:
            self.counts[name].add(n)

    def _once(self, provider: Provider, inputs: list, options: dict) -> list:
        self.count("calls")
        self.count("inputs", len(inputs))
        if self.timeout is None:
            return provider(inputs, **options)
        # A call that hangs keeps its thread; the task goes on without it.
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def call() -> None:
            try:
                answer.put((provider(inputs, **options), None))
            except Exception as error:
                answer.put((None, error))

        threading.Thread(target=call, daemon=True).start()
        try:
            found, error = answer.get(timeout=self.timeout)
        except queue.Empty:
            self.count("timeouts")
            raise TimeoutError(f"no answer in {self.timeout:g} s") from None
        if error is not None:
            raise error
        return found

    def call(self, provider: Provider, inputs: list, options: dict) -> list:
        for attempt in range(self.retries + 1):
            try:
                return self._once(provider, inputs, options)
            except Exception:
                if attempt == self.retries:
                    raise
                self.count("retries")
                time.sleep(self.backoff * 2**attempt)
        raise AssertionError


def _pair(answer: Any) -> tuple[Any, Any, str]:
    return (*answer, "") if isinstance(answer, tuple) else (answer, None, "")


def _ask_one(
    provider: Provider, text: str, options: dict, control: CallControl
) -> tuple[Any, Any, str]:
    try:
        return _pair(control.call(provider, [text], options)[0])
    except Exception as error:  # a provider failure is data, not a job failure
        return None, None, f"{type(error).__name__}: {error}"


def _ask_part(
    provider: Provider, part: list[str], options: dict, control: CallControl
) -> list[tuple[Any, Any, str]]:
    """Answers of one call; a failing call is repeated input by input, so one bad input fails alone."""
    try:
        answers = control.call(provider, part, options)
        if len(answers) != len(part):
            raise ValueError(f"{len(answers)} answers for {len(part)} inputs")
        return [_pair(answer) for answer in answers]
    except Exception:
        return [_ask_one(provider, text, options, control) for text in part]


def _ask(
    provider: Provider, inputs: list, options: dict, batch_size: int, control: CallControl
) -> dict:
    """Input -> (answer, rating, status); equal inputs of a batch are asked once."""
    known: dict = {None: (None, None, NULL_INPUT)}
    pending = [text for text in dict.fromkeys(inputs) if text is not None]
    for at in range(0, len(pending), batch_size):
        part = pending[at : at + batch_size]
        known.update(zip(part, _ask_part(provider, part, options, control), strict=True))
    return known


_ANSWER = "answer string, rating string, status string"


def _answer_column(
    column: Column, provider: Provider, options: dict, batch_size: int, control: CallControl
) -> Column:
    """The struct ``answer, rating, status`` of each input."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            inputs = array.to_pylist()
            known = _ask(provider, inputs, options, batch_size, control)
            columns = zip(*(known[text] for text in inputs), strict=True) if inputs else ([], [], [])
            yield pa.StructArray.from_arrays(
                [pa.array(c, pa.string()) for c in columns], ["answer", "rating", "status"]
            )

    return F.arrow_udf(run, _ANSWER, _PER_BATCH).asNondeterministic()(column)


def _with_answers(
    df: DataFrame, found: Column, result_col: str, rating_col: str | None, status_col: str | None
) -> DataFrame:
    name = "_answer"
    while name in df.columns:
        name = "_" + name
    parts = {"answer": result_col, "rating": rating_col, "status": status_col}
    return df.withColumn(name, found).select(
        *(F.col(f"`{c}`") for c in df.columns),
        *(F.col(name)[part].alias(column) for part, column in parts.items() if column),
    )


def apply_model(
    df: DataFrame,
    input_col: str,
    provider: Provider,
    result_col: str = RESULT,
    rating_col: str | None = RATING,
    status_col: str | None = STATUS,
    batch_size: int = 64,
    parallelism: int | None = None,
    distinct: bool = False,
    control: CallControl = CallControl(),
    store: AnswerStore | None = None,
    **options: Any,
) -> DataFrame:
    """``df`` plus answer, safety rating and status columns.

    The status is empty for an answer, ``null_input`` for a NULL input and the
    error text otherwise.  By default the rows are mapped in place: no shuffle,
    and equal inputs are asked once per Arrow batch.  With ``distinct`` equal
    inputs are asked once in all: they are reduced to distinct values (combined on
    the map side), answered, and joined back; use it where inputs repeat a lot.

    ``parallelism`` bounds the number of concurrent callers.  With a ``store`` nothing is
    asked here: answers are what the store holds when an action runs, and an input that it
    was not asked has the status ``not_asked``.
    """
    if store is not None:
        return store.attach(
            df, input_col, provider, result_col, rating_col, status_col, **options
        )
    if distinct:
        asked = df.select(input_col).where(F.col(input_col).isNotNull()).distinct()
        if parallelism:
            asked = asked.repartition(parallelism)
        answers = asked.select(
            F.col(input_col).alias("_input"),
            _answer_column(F.col(input_col), provider, options, batch_size, control).alias("_found"),
        )
        none = F.struct(
            F.lit(None).cast("string").alias("answer"),
            F.lit(None).cast("string").alias("rating"),
            F.lit(NULL_INPUT).alias("status"),
        )
        joined = df.join(answers, df[input_col] == F.col("_input"), "left")
        found = F.coalesce("_found", none)
        return _with_answers(joined, found, result_col, rating_col, status_col).drop("_input", "_found")
    source = df.repartition(parallelism) if parallelism else df
    found = _answer_column(F.col(input_col), provider, options, batch_size, control)
    return _with_answers(source, found, result_col, rating_col, status_col)


_STORED = "digest string, input string, answer string, rating string, status string, asked_at double"


class AnswerStore:
    """Answers by digest of model, options and input, kept in a folder across runs.

    ``ask`` asks for the distinct inputs that have no answer yet.  A task writes each
    batch of answers as a file as soon as it has them; when it is run again it finds the files
    of its earlier attempts and goes on behind them, so at most the batch that was under way is
    asked twice.  A run that was lost altogether leaves its answers to the next one.  Failed
    calls are kept for their status and asked again.

    The folder has to be one that pyarrow's file systems reach from every executor.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = ""):
        self.spark, self.path, self.model = spark, path, model

    def _digest(self, column: Column, options: dict) -> Column:
        setting = json.dumps([self.model, options], sort_keys=True, default=str)
        return F.sha2(F.concat(F.lit(setting), F.lit("\n"), column), 256)

    def answers(self) -> DataFrame:
        """``digest, answer, rating, status``: one row per digest, an answer before a failure."""
        try:
            rows = (
                self.spark.read.schema(_STORED)
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet")
                .parquet(self.path)
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _STORED)
        best = F.min_by(
            F.struct("answer", "rating", "status"),
            F.struct(F.col("status") != "", F.when(F.col("status") == "", F.col("asked_at")).otherwise(-F.col("asked_at"))),
        )
        return rows.groupBy(F.struct("digest").alias("key")).agg(best.alias("best")).select(
            "key.digest", "best.*"
        )

    def ask(
        self,
        df: DataFrame,
        input_col: str,
        provider: Provider,
        batch_size: int = 64,
        parallelism: int = 8,
        control: CallControl = CallControl(),
        **options: Any,
    ) -> int:
        """Ask for what is missing with at most ``parallelism`` callers; the number of inputs asked."""
        done = self.answers().where("status = ''").select("digest")
        missing = (
            df.select(F.col(input_col).cast("string").alias("input"))
            .where("input IS NOT NULL")
            .distinct()
            .withColumn("digest", self._digest(F.col("input"), options))
            .join(done, "digest", "left_anti")
            .select("digest", "input")
        )
        run = f"{self.path}/run-{uuid.uuid4()}"

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = f"{run}/part-{TaskContext.get().partitionId():05d}"
            system, place = _file_system(part)
            system.create_dir(place, recursive=True)
            known: set[str] = set()
            for info in system.get_file_info(pyarrow.fs.FileSelector(place)):
                if info.path.endswith(".parquet"):
                    table = pyarrow.parquet.read_table(info.path, ["digest"], filesystem=system)
                    known.update(table.column(0).to_pylist())
            for batch in batches:
                pending = [
                    (d, t)
                    for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    if d not in known
                ]
                for at in range(0, len(pending), batch_size):
                    digests, inputs = map(list, zip(*pending[at : at + batch_size], strict=True))
                    found = _ask_part(provider, inputs, options, control)
                    answers, ratings, states = zip(*found, strict=True)
                    columns = [digests, inputs, answers, ratings, states]
                    table = pa.table(
                        [*(pa.array(c, pa.string()) for c in columns), pa.array([time.time()] * len(inputs))],
                        names=["digest", "input", "answer", "rating", "status", "asked_at"],
                    )
                    name = f"{place}/{uuid.uuid4()}"
                    with system.open_output_stream(f"{name}.part") as sink:
                        pyarrow.parquet.write_table(table, sink)
                    system.move(f"{name}.part", f"{name}.parquet")
                    yield pa.RecordBatch.from_pydict({"asked": pa.array([len(inputs)], pa.int64())})

        # By digest, so that a task that is run again has the same inputs.
        counted = missing.repartition(parallelism, "digest").mapInArrow(answer, "asked long")
        return counted.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]

    def attach(
        self,
        df: DataFrame,
        input_col: str,
        provider: Provider | None = None,
        result_col: str = RESULT,
        rating_col: str | None = RATING,
        status_col: str | None = STATUS,
        **options: Any,
    ) -> DataFrame:
        """``df`` with the stored answers to its inputs; asks nothing."""
        text = F.col(f"`{input_col}`").cast("string")
        keyed = df.withColumn("_digest", self._digest(text, options))
        held = self.answers().select(
            F.col("digest").alias("_held"), F.struct("answer", "rating", "status").alias("_found")
        )
        missing = F.struct(
            F.lit(None).cast("string").alias("answer"),
            F.lit(None).cast("string").alias("rating"),
            F.when(text.isNull(), NULL_INPUT).otherwise(NOT_ASKED).alias("status"),
        )
        joined = keyed.join(held, F.col("_digest") == F.col("_held"), "left")
        return _with_answers(
            joined, F.coalesce("_found", missing), result_col, rating_col, status_col
        ).drop("_digest", "_held", "_found")

    def apply(
        self,
        df: DataFrame,
        input_col: str,
        provider: Provider,
        result_col: str = RESULT,
        rating_col: str | None = RATING,
        status_col: str | None = STATUS,
        batch_size: int = 64,
        parallelism: int = 8,
        control: CallControl = CallControl(),
        **options: Any,
    ) -> DataFrame:
        """Ask for what is missing, now, and attach the answers."""
        self.ask(df, input_col, provider, batch_size, parallelism, control, **options)
        return self.attach(df, input_col, None, result_col, rating_col, status_col, **options)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def embed(
    df: DataFrame,
    columns: dict[str, tuple[str, Provider]],
    batch_size: int = 64,
    control: CallControl = CallControl(),
    **options: Any,
) -> DataFrame:
    """``df`` plus ``array<double>`` embeddings, all in one pass over the rows.

    ``columns`` maps an output column to its input column (a text or an image URI)
    and its provider.  A NULL input and a failed call give NULL.
    """
    vector = pa.list_(pa.float64())

    def column(source: str, provider: Provider) -> Column:
        def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for array in arrays:
                inputs = array.to_pylist()
                known = _ask(provider, inputs, options, batch_size, control)
                yield pa.array([known[text][0] for text in inputs], vector)

        return F.arrow_udf(run, "array<double>", _PER_BATCH).asNondeterministic()(F.col(source))

    return df.select(
        "*", *(column(source, provider).alias(name) for name, (source, provider) in columns.items())
    )
