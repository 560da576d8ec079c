"""Server-sent events from text that comes in chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuemill.streaming.state import IDLE_MS, in_order, stateful

EVENT = "stream_id string, n int, id string, event string, data string"


def _joined(part: str, *order: str) -> Column:
    """The parts of a group put together in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part))), lambda x: x[part]), "")


def _lines(chunks: DataFrame) -> DataFrame:
    """stream_id, line, text of all lines that have ended. Only what stands at the borders of chunks is put together."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A CR ends its line at once; an LF right behind it belongs to it, also where a chunk ends between them.
    rows = chunks.where("text <> ''").select("stream_id", "seq", "text", F.lag(F.right("text", F.lit(1))).over(order).alias("last"))
    mine = F.when(F.col("last") == "\r", F.regexp_replace("text", r"\A\n", "")).otherwise(F.col("text"))
    parts = rows.select("stream_id", "seq", F.split(mine, "\r\n|\r|\n", -1).alias("parts"))
    # The first part goes on with the line that earlier chunks have left open; each further one opens a new line.
    placed = parts.select("stream_id", "seq", "parts", F.coalesce(F.sum(F.size("parts") - 1).over(before), F.lit(0)).alias("base"), F.sum(F.size("parts") - 1).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("ended"))
    cut = placed.select("stream_id", "seq", "base", "ended", F.posexplode("parts").alias("i", "part")).withColumn("line", F.col("base") + F.col("i")).where("line < ended")
    return cut.groupBy("stream_id", "line").agg(_joined("part", "seq").alias("text"))


def events(chunks: DataFrame) -> DataFrame:
    """stream_id, n, id, event, data of whole streams. chunks: stream_id, seq, text.

    Lines end in CR, LF or both; a blank line ends an event; what follows the last one is dropped. An id holds until the
    next; ids with NUL don't count. Chunks may end anywhere. A stream is sorted in one task, which holds a chunk, a line or an
    event at a time: numbers of lines and of events are running sums, and the id in force is the last one before.
    """
    lines = _lines(chunks.repartition("stream_id"))
    stream = Window.partitionBy("stream_id")
    blank = (F.col("text") == "").cast("int")
    placed = lines.select("stream_id", "line", "text", F.coalesce(F.sum(blank).over(stream.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block"), F.sum(blank).over(stream).alias("blocks"))
    named = placed.where("text <> '' AND block < blocks").select("stream_id", "block", "line", F.regexp_extract("text", r"(?s)\A([^:]*)", 1).alias("field"), F.regexp_replace("text", r"(?s)\A[^:]*:? ?", "").alias("value"))
    last = lambda c: F.max_by("value", F.when(c, F.col("line")))
    data = F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "data", F.struct("line", "value")))), lambda x: x["value"])
    made = named.groupBy("stream_id", "block").agg(last((F.col("field") == "id") & ~F.col("value").contains("\0")).alias("own"), last(F.col("field") == "event").alias("event"), data.alias("data"))
    order = stream.orderBy("block")
    held = made.withColumn("id", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.size("data") > 0)
    return held.select("stream_id", (F.row_number().over(order) - 1).alias("n"), F.nullif("id", F.lit("")).alias("id"), F.coalesce(F.nullif("event", F.lit("")), F.lit("message")).alias("event"), F.array_join("data", "\n").alias("data"))


class Reader:
    """What is left of a stream between chunks: the text of an unfinished event, the last id, the count, and whether a CR
    came last, whose LF may open the next chunk."""

    def __init__(self, kept: str | None = None):
        self.rest, self.id, self.n, self.after_cr = json.loads(kept) if kept else ("", "", 0, False)

    def kept(self) -> str:
        return json.dumps([self.rest, self.id, self.n, self.after_cr])

    def feed(self, text: str) -> Iterator[tuple]:
        if text:
            text, self.after_cr = text.removeprefix("\n") if self.after_cr else text, text.endswith("\r")
        *blocks, self.rest = re.split(r"(?<=\n)\n", self.rest + re.sub(r"\r\n|\r", "\n", text))
        for block in blocks:
            data, event = [], ""
            for line in block.split("\n"):
                field, _, value = line.partition(":")
                value = value.removeprefix(" ")
                if field == "data" and line:
                    data.append(value)
                elif field == "event":
                    event = value
                elif field == "id" and "\0" not in value:
                    self.id = value
            if data:
                yield self.n, self.id or None, event or "message", "\n".join(data)
                self.n += 1


class Parser(StatefulProcessor):
    """Keeps of each stream what its Reader keeps."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "kept string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        reader = Reader(self.rest.get()[0] if self.rest.exists() else None)
        for chunk in in_order(rows, "seq"):
            for n, i, event, data in reader.feed(chunk["text"] or ""):
                yield Row(stream_id=key[0], n=n, id=i, event=event, data=data)
        self.rest.update((reader.kept(),))


def event_stream(chunks: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The events of a stream of chunks, as soon as each is whole. A stream is forgotten idle_ms after its last chunk."""
    return stateful(chunks.select("stream_id", "seq", "text"), "stream_id", Parser(idle_ms), EVENT, "append")
