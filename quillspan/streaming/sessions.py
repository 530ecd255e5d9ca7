"""The session machine over a stream of inputs, its state kept per session; and completions of a stream of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import displayed
from ..operators.completion import batch_completions, display_order_columns
from ..operators.session import NO_MATCHES, Generator, State, Translator, step

OUTPUT = "session_id string, seq long, mode string, query string, context string, asked string, output string, should_exit boolean"
STATE = "mode string, query string, context string"


class SessionProcessor(StatefulProcessor):
    """``step`` with a session's state in the state store. Rows of a batch are taken in the order of ``seq``.

    What has to be searched for is put out as ``asked``, with the output that goes before its answer: one search over the
    lines answers all sessions of a batch (``answered``). ``generator`` and ``translator`` make clients where the task runs.
    """

    def __init__(self, generator: Callable[[], Generator] | None = None, translator: Callable[[], Translator] | None = None) -> None:
        self.made = generator, translator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)
        self.generator, self.translator = (make() if make else None for make in self.made)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get()) if self.state.exists() else State()
        # one session's inputs are answered in order, so those of one batch meet here; the trigger bounds their number
        inputs = sorted((int(s), t if isinstance(t, str) else "") for part in rows for s, t in zip(part["seq"], part["text"], strict=True))
        out = []
        for seq, text in inputs:
            asked: list[str] = []

            def later(q: str, asked: list[str] = asked) -> list[Any]:
                asked.append(q)
                return []

            done = step(state, text, later, self.generator, self.translator)
            state = done.state
            output = done.output.removesuffix(NO_MATCHES) if asked else done.output
            out.append((key[0], seq, state.mode, state.query, state.context, asked[0] if asked else None, output, done.should_exit))
        self.state.update((state.mode, state.query, state.context))
        yield pd.DataFrame(out, columns=["session_id", "seq", "mode", "query", "context", "asked", "output", "should_exit"])

    def close(self) -> None:
        pass


def session_stream(inputs: DataFrame, generator: Callable[[], Generator] | None = None, translator: Callable[[], Translator] | None = None) -> DataFrame:
    """``(session_id string, seq long, text string)`` to each input's state, what it asks for, and output. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``); a restart goes on where the checkpoint stands."""
    return inputs.groupBy("session_id").transformWithStateInPandas(SessionProcessor(generator, translator), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def answered(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """A batch of ``session_stream``'s rows with their answers in ``output``, from one search for all that they ask."""
    wanted = rows.where(F.col("asked").isNotNull()).select(F.struct("session_id", "seq").alias("query_id"), F.col("asked").alias("query"))
    best = batch_completions(sentences, wanted)
    line = F.format_string("%s (%s:%d, score=%d)", displayed(F.col("completed_sentence")), "source_text", "offset", "score")
    lists = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*display_order_columns(), line.alias("line")))).alias("_l"))
    size = F.size("_l")
    text = F.concat(F.lit("Here are "), size.cast("string"), F.lit(" suggestions:"), F.array_join(F.transform("_l", lambda x, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), x["line"])), ""))
    both = rows.join(lists, F.struct("session_id", "seq") == F.col("query_id"), "left")
    answer = F.when(F.col("asked").isNull(), F.col("output")).otherwise(F.concat("output", F.coalesce(text, F.lit(NO_MATCHES))))
    return both.select(*(c if c != "output" else answer.alias("output") for c in rows.columns))


def answer_stream(
    inputs: DataFrame,
    sentences: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    generator: Callable[[], Generator] | None = None,
    translator: Callable[[], Translator] | None = None,
) -> StreamingQuery:
    """Sessions that answer: every micro-batch's inputs with their outputs, over the lines that are current then."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # it is read twice, and a stateful batch can't be run again
        try:
            write(answered(rows, sentences()), number)
        finally:
            rows.unpersist()

    return session_stream(inputs, generator, translator).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_stream(queries: DataFrame, sentences: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> StreamingQuery:
    """Completions of a stream ``(query_id, query)``: every micro-batch is joined with the lines that are current then."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch_completions(sentences(), batch, k), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
