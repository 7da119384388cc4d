"""Chat formatting at the level of tokens: segments are encoded separately and reserved ids are put between them.

The marks of the template are ids that no text can encode to, so no content can forge a turn. In the formatted text,
control strings that occur in content are broken by a backslash, which reading takes out again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bpe
from tessella.llm._shared import documents, hex_sha256, portions, with_columns

#: Marks of the template, in the order of their reserved ids, which follow the tokenizer's own.
START, HEADER_END, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (START, HEADER_END, TURN_END)
#: Control strings of this and of other templates, all broken where content has them.
CONTROLS = (*MARKS, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose texts bear the loss.
LEARNED = "assistant"
_FOUND = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes are doubled, then a control string gets one after its first character, so it no longer occurs."""
    return _FOUND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of escape(): of two backslashes one stays, a single one goes."""
    return _BACK.sub(r"\1", text)


def encode_segments(turns: DataFrame, path: str) -> DataFrame:
    """turns (conv_id, turn, role, text) with role_ids and text_ids: escaped and encoded, each by itself. Null is empty."""

    def run(batches):
        coder = bpe.encoder(path, False)
        for batch in portions(batches):
            more = {}
            for name in ("role", "text"):
                flat, ends = coder.encode([escape(x or "") for x in batch.column(batch.schema.get_field_index(name)).to_pylist()])
                more[f"{name}_ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield with_columns(batch, **more)

    more = [T.StructField(f"{name}_ids", T.ArrayType(T.IntegerType())) for name in ("role", "text")]
    return turns.mapInArrow(run, T.StructType([*turns.schema.fields, *more]))


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, ids, loss (a byte per id: 1 where an assistant's text is), formatted.

    A turn is START, role, HEADER_END, text, TURN_END. Turns are in the order of `turn` (nulls first; ties by role and
    text; repeated rows are turns of their own); null roles and texts are empty; rows of a null conv_id form one
    conversation. Extra columns are left out. A conversation is one row of the result and so is put together by one task.
    """
    path = path or bpe.default_tokenizer()
    size = bpe.encoder(path).size
    ready = encode_segments(turns.select("conv_id", "turn", "role", "text"), path)
    whole = ready.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids"))).alias("_turns"))
    whole = whole.select("conv_id", F.transform("_turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), t["role_ids"].alias("role_ids"), t["text_ids"].alias("text_ids"))).alias("_turns"))

    def splice(batches):
        coder = bpe.encoder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                turns = part.column(1).to_pylist()[0]
                segments, learned = [], []
                for t in turns:
                    segments += [[size], t["role_ids"], [size + 1], t["text_ids"], [size + 2]]
                    learned += [0, 0, 0, int(t["role"] == LEARNED), 0]
                lengths = np.fromiter(map(len, segments), np.int64, len(segments))
                ends = np.cumsum(lengths)
                # The mask as the prefix sum of +1 where a learned segment begins and -1 where it ends.
                change = np.zeros(int(ends[-1]) + 1, np.int8)
                for k in np.nonzero(np.array(learned) * lengths)[0]:
                    change[ends[k] - lengths[k]] += 1
                    change[ends[k]] -= 1
                text = "".join(MARKS[s[0] - size] if k % 5 in (0, 2, 4) else coder.decode(s) for k, s in enumerate(segments))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[i for s in segments for i in s]], pa.list_(pa.int32())), pa.array([np.cumsum(change)[:-1].astype(np.int8).tobytes()], pa.binary()), pa.array([text])], names=["conv_id", "ids", "loss", "formatted"])

    kind = turns.schema["conv_id"].dataType
    return whole.mapInArrow(splice, T.StructType([T.StructField("conv_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss", T.BinaryType()), T.StructField("formatted", T.StringType())]))


def read_conversations(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """formatted with `turns` (array<struct<role, text>>) and `loss_text`, both read from ids and loss alone."""
    path = path or bpe.default_tokenizer()
    size = bpe.encoder(path).size

    def run(batches):
        coder = bpe.encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index
            turns, losses = [], []
            for ids, mask in zip(batch.column(at("ids")), batch.column(at("loss"))):
                ids, mask = np.array(ids.as_py(), np.int64), np.frombuffer(mask.as_py(), np.int8)
                marks = np.nonzero(ids >= size)[0].reshape(-1, 3)
                text = lambda a, b: unescape(coder.decode(ids[a:b].tolist()))
                turns.append([{"role": text(a + 1, b), "text": text(b + 1, c)} for a, b, c in marks])
                edges = np.nonzero(np.diff(np.concatenate([[0], mask, [0]])))[0].reshape(-1, 2)
                losses.append("".join(text(a, b) for a, b in edges))
            yield with_columns(batch, turns=pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), loss_text=pa.array(losses, pa.string()))

    one = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return formatted.mapInArrow(run, T.StructType([*formatted.schema.fields, T.StructField("turns", T.ArrayType(one)), T.StructField("loss_text", T.StringType())]))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, LEARNED, tricky)], "conv_id long, turn long, role string, text string")
    out = read_conversations(format_conversations(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), hex_sha256("loss_text").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROLS_SQL = "|".join(re.escape(c).replace("'", "''") for c in sorted(CONTROLS, key=len, reverse=True))
QUERIES = {"op4_chat_formatting": op4_chat_formatting}
SQL = {
    # Content has few control strings here, so the SQL counts each one's extra character instead of escaping.
    "op4_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
  + len(regexp_extract_all(text, '{_CONTROLS_SQL}')) + len(regexp_extract_all(role, '{_CONTROLS_SQL}')) + {sum(map(len, MARKS))} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
}
