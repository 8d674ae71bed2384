"""Queries over whole tables and texts, on the rows that their narrower twins leave out."""

import base64
import gzip
import hashlib
from urllib.parse import quote

import pytest

import __spark_entry__ as driver
from vigil.operators.decode import _peel

TEXTS = ["", "a", "ab", "abc", "é", "plain words here", "100% of it", "a%20b", "back\\\\slash \\\\t", "YWJjZGVmZ2g=", "deadbeef", "a\x00b", "bell\x07 rings", "日本語 text", "  pad  ", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(3 * i + m, t, "en", "s") for i, t in enumerate(TEXTS) for m in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text is not None else None


def coded(i, text):
    if text is None:
        return None
    return [base64.b64encode(text.encode()).decode(), text.encode().hex().upper(), quote(text, safe="")][i % 3]


def peeled(text):
    return _peel(text) if text is not None else (None, [])


def test_chain_of_every_text(spark, folder):
    path, rows = folder
    want = {(i, sha(p[0]), ",".join(p[1])) for i, t, *_ in rows for p in [peeled(coded(i, t))]}
    got = driver.queries()["decode_chain_all"](spark, path).collect()
    assert {(r.doc_id, r.decoded_hash, r.chain or "") for r in got} == want and len(got) == len(rows)


def test_gzip_of_every_text(spark, folder):
    path, rows = folder
    want = {(i, sha(p[0]), ",".join(p[1])) for i, t, *_ in rows for p in [peeled(None if t is None else base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())]}
    got = driver.queries()["decode_gzip_all"](spark, path).collect()
    assert {(r.doc_id, r.decoded_hash, r.chain or "") for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize(("name", "least"), [("decode_base64_all", 1), ("decode_hex_all", 2)])
def test_one_layer_of_every_text(spark, folder, name, least):
    path, rows = folder
    clean = lambda t: t is not None and len(t.encode()) >= least and not any(c in t for c in "\x00\x07")
    got = driver.queries()[name](spark, path).collect()
    assert {(r.doc_id, r.h) for r in got} == {(i, sha(t) if clean(t) else None) for i, t, *_ in rows} and len(got) == len(rows)
