"""Keyed conversation state on Structured Streaming, and its batch twin.

A message passes the privacy gate in columns first; blocked ones change no state. Kept state per conversation: whether a tax number is
awaited, the number, and the last eight messages (only their roles and texts that passed the gate). Commands: ``/start`` resets,
``/ruc`` awaits a number, ``/reiniciar`` forgets all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tax_id_valid
from ..operators.privacy import inspected

STORED, PROMPTED = 8, 4
_OUT = "conv_id long, turn long, action string, prompt_messages int, stored_messages int, tax_id string"
_STATE = "awaiting boolean, tax_id string, roles array<string>, texts array<string>"


def gated(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, blocked, digits_valid): the text of a blocked message goes no further."""
    digits = F.regexp_replace(F.coalesce("text", F.lit("")), "[^0-9]", "")
    blocked = F.col("verdict.blocked")
    return inspected(messages.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", F.when(~blocked, F.col("text")).alias("text"), blocked.alias("blocked"), F.when(tax_id_valid(digits), digits).alias("tax_id"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    awaiting, tax_id, roles, texts = state.get if state.exists else (False, None, [], [])
    roles, texts, out = list(roles), list(texts), []
    rows = pd.concat(list(frames)).sort_values("turn")
    for r in rows.itertuples():
        text = (r.text or "").strip()
        prompt = 0
        if r.blocked:
            action = "blocked"
        elif text in ("/start", "/reiniciar"):
            action, awaiting, tax_id, roles, texts = "reset", text == "/start", None, [], []
        elif text == "/ruc":
            action, awaiting = "await", True
        elif awaiting and r.tax_id:
            action, awaiting, tax_id = "tax_id", False, r.tax_id
        else:
            action, prompt = "message", min(PROMPTED, len(texts))
            roles, texts = [*roles, r.role][-STORED:], [*texts, text][-STORED:]
        out.append((key[0], r.turn, action, prompt, len(texts), tax_id))
    state.update((awaiting, tax_id, roles, texts))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "action", "prompt_messages", "stored_messages", "tax_id"])


def sessions(messages: DataFrame) -> DataFrame:
    """The stream (conv_id, turn, role, text) as one output row per message; works on a stream only."""
    return gated(messages).groupBy("conv_id").applyInPandasWithState(_step, _OUT, _STATE, "append", "NoTimeout")


def run_stream(spark, folder: str, schema, checkpoint: str, table: str) -> DataFrame:
    """Runs the files of ``folder`` through ``sessions`` to the end, into a memory table."""
    query = sessions(spark.readStream.schema(schema).parquet(folder)).writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)


def histories(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, blocked, prompt_messages, stored_messages, prompt) in batch: what a stream without commands gives.

    A conversation's turns are one window; the frame of four rows needs no more than these."""
    g = gated(messages).withColumn("_pass", (~F.col("blocked")).cast("int"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = F.coalesce(F.sum("_pass").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = g.filter("NOT blocked")
    last = F.collect_list(F.concat_ws(": ", "role", "text")).over(w.rowsBetween(-PROMPTED, -1))
    prompt = passed.select("conv_id", "turn", F.array_join(last, "\n").alias("prompt"))
    counted = g.select("conv_id", "turn", "blocked", F.when(F.col("blocked"), 0).otherwise(F.least(seen, F.lit(PROMPTED))).cast("int").alias("prompt_messages"), F.least(seen + F.col("_pass"), F.lit(STORED)).cast("int").alias("stored_messages"))
    return counted.join(prompt, ["conv_id", "turn"], "left")
