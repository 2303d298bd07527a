"""Event frames out of byte chunks that are cut anywhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vellum.operators.lifecycle import event_frames, parsed_events

END = b"\n\n"


def split_frames(tail: bytes, chunk: bytes) -> tuple[list[bytes], bytes]:
    """The frames that a chunk completes, and what is left. Only the part that is new is searched for ends."""
    data = tail + chunk
    if END not in data[max(0, len(tail) - 1) :]:
        return [], data
    *frames, rest = data.split(END)
    return frames, rest


def event_stream(chunks: DataFrame, schema: str, stream: str = "stream", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Events of streams that arrive in binary chunks: (stream, frame_idx, event), as ``event_frames`` gives for whole texts.

    The state of a stream is its unfinished tail and the number of frames so far, so it is bounded by one frame.
    Chunks may end inside a character or a frame's end. Those of one micro-batch are ordered by ``seq``;
    micro-batches come in order. Null chunks add nothing; a byte order mark at the start is dropped.
    """
    kinds = dict(chunks.dtypes)

    def run(key, batches, state):
        tail, n = state.get if state.exists else (b"", 0)
        tail, out = bytes(tail), []
        for part in sorted((p for pdf in batches for p in zip(pdf[seq], pdf[chunk]) if p[1] is not None), key=lambda p: p[0]):
            frames, tail = split_frames(tail, bytes(part[1]))
            for frame in frames:
                out.append((key[0], n, frame.decode("utf-8-sig" if n == 0 else "utf-8", "replace")))
                n += 1
        state.update((tail, n))
        yield pd.DataFrame(out, columns=[stream, "frame_idx", "_f"])

    whole = chunks.select(stream, seq, chunk).groupBy(stream).applyInPandasWithState(run, f"{stream} {kinds[stream]}, frame_idx int, _f string", "tail binary, frames int", "append", GroupStateTimeout.NoTimeout)
    return parsed_events(whole, schema)


def joined_chunks(chunks: DataFrame, schema: str, stream: str = "stream", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """The same for stored text chunks, with the chunks of each stream put together in order first."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda c: c[chunk]), "")
    return event_frames(chunks.groupBy(stream).agg(text.alias("_text")), "_text", schema)


def outcome(events: DataFrame, stream: str, type_: Column, error: Column) -> DataFrame:
    """Per stream how the job ended: its last error (conversion failed, if it names none), else done, else that it ended unexpectedly."""
    failed = F.max_by(F.when(type_ == "error", F.coalesce(F.nullif(error, F.lit("")), F.lit("conversion failed"))), F.when(type_ == "error", F.col("frame_idx")))
    done = F.bool_or(type_ == "done")
    return events.groupBy(stream).agg(F.coalesce(failed, F.when(done, "done"), F.lit("conversion ended unexpectedly")).alias("outcome"))
