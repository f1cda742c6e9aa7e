"""Chat formatting by columnar byte assembly.

A turn is written as <s>[INST]role[/INST], a new line, its text, </s> and a new line. A control string inside
a role or text (also one that already looks escaped) gets a backslash after its first character; reading back
takes one away. Turns are assembled a batch at a time: segment lengths, cumulative offsets and scatter indices
are computed in numpy, and headers and contents are copied into one preallocated Arrow buffer.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, slices, small_batches, staged

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]\n", b"</s>\n"
#: The control strings' forms; k backslashes follow the first character of one escaped k times.
CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
ESCAPED = regex.compile(rb"([<\[])\\(\\*/?(?:s>|INST\]))")
#: Bytes of a conversation that go into one row; a longer one takes several.
CHUNK_BYTES = 8 << 20
ROLE_LEARNT = "assistant"


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(text, "").cast(pa.large_string()), CONTROL, r"\1\\\2")


def unescape(raw: bytes) -> bytes:
    return ESCAPED.sub(rb"\1\2", raw) if b"\\" in raw else raw


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and bytes of a large string column."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets[:-1], np.diff(offsets), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes; each turn's end; the start and end of its text."""
    n = len(role)
    parts = [OPEN, _bytes(escape(role)), MIDDLE, _bytes(escape(text)), CLOSE]
    lens = np.stack([np.full(n, len(p)) if isinstance(p, bytes) else p[1] for p in parts], axis=1)
    ends = np.cumsum(lens.ravel()).reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
    starts = ends - lens
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, part in enumerate(parts):
        if isinstance(part, bytes):
            out[starts[:, k, None] + np.arange(len(part))] = np.frombuffer(part, np.uint8)
        else:
            out[ragged(starts[:, k], lens[:, k])] = part[2][ragged(part[0], part[1])]
    return out, ends[:, -1], starts[:, 3], ends[:, 3]


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learnt: str = ROLE_LEARNT) -> DataFrame:
    """(id_col, chunk, n_turns, formatted, loss_starts, loss_ends) for every conversation, formatted in order of turns.

    loss_starts and loss_ends are byte offsets in `formatted` of the texts whose role is `learnt`. A
    conversation of more than CHUNK_BYTES takes several rows, cut between turns. Null roles and texts are empty
    ones; a null turn comes first; turns with one number follow each other by role and text, repeated rows too.
    Null ids make one conversation. Other columns are not looked at. An empty table gives an empty result.
    """
    small_batches(rows.sparkSession)
    thin = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = thin.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    names = ["id", "chunk", "n_turns", "formatted", "loss_starts", "loss_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, size = [], 0, 0  # of the last conversation, which may go on
        for batch in slices(batches, "text"):
            ids = batch.column("id")
            cuts = np.flatnonzero(_changes(ids)) + 1
            data, ends, a, b = assemble(batch.column("role"), batch.column("text"))
            learns = pc.fill_null(pc.equal(batch.column("role"), learnt), False).to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], cuts, [len(ids)]))
            turn_starts = np.concatenate(([0], ends))
            if held and held[0][0] != ids[0]:
                yield _row(held, chunk, names)
                held, chunk, size = [], 0, 0
            if held and size >= CHUNK_BYTES:
                yield _row(held, chunk, names)
                held, chunk, size = [], chunk + 1, 0
            # The first conversation may continue one, the last may be continued: those go through `held`.
            for i in sorted({0, len(edges) - 2}):
                if i == 0:
                    held.append(_piece(ids, edges, i, data, turn_starts, a, b, learns))
                    size += len(held[-1][2])
                if i == 0 and len(edges) > 2:
                    yield _row(held, chunk, names)
                    held, chunk, size = [], 0, 0
                if i and len(edges) > 3:
                    yield _whole(ids, edges[1:-1], data, turn_starts, a, b, learns, names)
                if i:
                    held, size = [_piece(ids, edges, i, data, turn_starts, a, b, learns)], 0
                    size = len(held[0][2])
        if held:
            yield _row(held, chunk, names)

    schema = thin.select("id").schema
    for name, kind in (("chunk", "long"), ("n_turns", "long"), ("formatted", "binary")):
        schema = schema.add(name, kind)
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", loss_starts array<long>, loss_ends array<long>"
    return ordered.mapInArrow(run, text).withColumnRenamed("id", id_col)


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it, without the first; nulls are equal."""
    if len(ids) < 2:
        return np.zeros(0, bool)
    coded = pc.fill_null(pc.dictionary_encode(ids, null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
    return np.diff(coded) != 0


def _piece(ids, edges, i, data, turn_starts, a, b, learns) -> tuple:
    x, y = int(edges[i]), int(edges[i + 1])
    at = int(turn_starts[x])
    which = np.flatnonzero(learns[x:y]) + x
    return ids[x], y - x, data[at : int(turn_starts[y])], a[which] - at, b[which] - at


def _row(held: list, chunk: int, names: list) -> pa.RecordBatch:
    """One row from the pieces of a conversation."""
    base = np.cumsum([0, *(len(h[2]) for h in held)])
    starts, ends = (np.concatenate([h[k] + z for h, z in zip(held, base, strict=False)]) for k in (3, 4))
    whole = np.concatenate([h[2] for h in held]).tobytes()
    arrays = [pa.array([held[0][0].as_py()], held[0][0].type), pa.array([chunk]), pa.array([sum(h[1] for h in held)]), pa.array([whole], pa.binary())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], names=names)


def _whole(ids, edges, data, turn_starts, a, b, learns, names) -> pa.RecordBatch:
    """Rows for the conversations between edges, without copying: the assembled buffer becomes the column's."""
    n = len(edges) - 1
    cut = turn_starts[edges]
    formatted = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
    which = np.flatnonzero(learns[edges[0] : edges[-1]]) + edges[0]
    conv = np.searchsorted(edges, which, side="right") - 1
    spans = pa.array(np.searchsorted(conv, np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(spans, pa.array(x[which] - cut[conv])) for x in (a, b)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(edges[:-1])), pa.array(np.zeros(n, np.int64)), pa.array(np.diff(edges)), formatted, *lists], names=names)


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of every turn, unescaped."""
    at = 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at)
        end = formatted.index(CLOSE, middle)
        yield unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(MIDDLE) : end])
        at = end + len(CLOSE)


def _code_points(raw: bytes) -> int:
    return len(raw.decode())


def digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What formatted conversations say when read back, a row for each; a conversation's chunks are read in order."""
    ordered = chats.repartition(id_col).sortWithinPartitions(id_col, "chunk").select(F.col(id_col).alias("id"), "chunk", "n_turns", "formatted", "loss_starts", "loss_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["chunk"] == 0:
                    if state:
                        out.append(state)
                    state = {"id": r["id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                raw = r["formatted"]
                state["n"] += r["n_turns"]
                state["size"] += _code_points(raw)
                for role, text in parse(raw):
                    state["turns"].update(role + b"\n" + text + b"\n")
                for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    text = unescape(raw[a:b])
                    state["loss"].update(text)
                    state["chars"] += _code_points(text)
            if len(out) > 1000:
                yield made(out, batch.schema.field("id").type)
                out = []
            kind = batch.schema.field("id").type
        if state:
            yield made([*out, state], kind)

    def made(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r["id"] for r in rows], kind), *[pa.array([f(r) for r in rows]) for f in (lambda r: r["n"], lambda r: r["turns"].hexdigest(), lambda r: r["chars"], lambda r: r["loss"].hexdigest(), lambda r: r["size"])]],
            names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    kind = ordered.schema["id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return digests(staged(format_chats(rows.unionByName(more)), "chats"))


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + 22 AS n
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
