"""The registered token queries, column by column, against the library."""

import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

from tessella.llm import bpe, token_files

FOLDER = "/root/testdata/sf0.001"


def coded(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    model = Tokenizer.from_file(bpe.default_tokenizer())
    ids = [e.ids for e in model.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    return model, {r.doc_id: x for r, x in zip(rows, ids)}


def test_op2_columns(spark):
    model, ids = coded(spark)
    out = {r.doc_id: r for r in bpe.op2_transducer_bpe(spark, FOLDER).collect()}
    assert out.keys() == ids.keys()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc, own in ids.items():
        assert (out[doc].n_tokens, out[doc].ids_sha256, out[doc].decoded_sha256) == (len(own), sha(",".join(map(str, own))), sha(model.decode(own, skip_special_tokens=False)))


def test_op8_columns(spark):
    _, ids = coded(spark)
    out, start = {r.doc_id: r for r in token_files.op8_token_files(spark, FOLDER).collect()}, 0
    assert out.keys() == ids.keys()
    for doc in sorted(ids):
        own = [*ids[doc], token_files.END]
        assert (out[doc].start, out[doc].n_tokens, out[doc].ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
