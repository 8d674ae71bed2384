"""Layered payload decoding: url, backslash escapes, unicode escapes, gzip, base64, hex."""

from __future__ import annotations

import base64
import binascii
import codecs
import gzip
import re
import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.exprs import any_of, strip

MAX_PASSES = 5
DECODED = T.StructType().add("text", T.StringType()).add("chain", T.ArrayType(T.StringType()))
B64_TEXT = re.compile(r"[A-Za-z0-9+/=\s]+")
HEX_TEXT = re.compile(r"[0-9a-fA-F]+")


def _readable(text: str) -> bool:
    return all(ch.isprintable() or ch in "\r\n\t" for ch in text)


def _url(text):
    return unquote(text) if "%" in text else None


def _escaped(text):
    if "\\" not in text:
        return None
    return codecs.escape_decode(text.encode("utf-8"))[0].decode("utf-8")


def _unicode(text):
    def char(match):
        return chr(int(match.group(1), 16))

    return re.sub(r"\\U([0-9a-fA-F]{8})", char, re.sub(r"\\u([0-9a-fA-F]{4})", char, text))


def _bytes_base64(text):
    body = text.strip()
    if len(body) < 4 or not B64_TEXT.fullmatch(body):
        return None
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _bytes_hex(text):
    body = "".join(text.split())
    if len(body) < 4 or len(body) % 2 or not HEX_TEXT.fullmatch(body):
        return None
    return bytes.fromhex(body)


def _gzip(text):
    for unwrap in (_bytes_base64, _bytes_hex):
        try:
            data = unwrap(text)
            if data and data[:2] == b"\x1f\x8b":
                plain = gzip.decompress(data).decode("utf-8", errors="replace")
                if _readable(plain[:200]):
                    return plain
        except (ValueError, OSError, EOFError, zlib.error):
            continue
    return None


def _plain(unwrap):
    def decode(text):
        data = unwrap(text)
        plain = data.decode("utf-8") if data is not None else None
        return plain if plain and _readable(plain) else None

    return decode


# tried in this order; the first one that changes the text wins the pass
DECODERS = [
    ("url", _url),
    ("escaped", _escaped),
    ("unicode_escape", _unicode),
    ("gzip", _gzip),
    ("base64", _plain(_bytes_base64)),
    ("hex", _plain(_bytes_hex)),
]


def _one_pass(text):
    for name, decoder in DECODERS:
        try:
            changed = decoder(text)
        except (ValueError, OverflowError, binascii.Error):
            continue
        if changed and changed != text:
            return name, changed
    return None


def _peel(text):
    chain = []
    while len(chain) < MAX_PASSES and (step := _one_pass(text)):
        chain.append(step[0])
        text = step[1]
    return text, chain


@F.pandas_udf(DECODED)
def _peel_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_peel(t) if t is not None else (None, []) for t in texts], columns=["text", "chain"])


def short_batches(spark: SparkSession) -> None:
    """Payloads can be long: a batch that goes to Python holds so many bytes, and so many rows of short ones, whatever the size of the table.
    Rows count too, since a packed payload comes back many times as long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def maybe_encoded(col: Column) -> Column:
    """Cheap test that no undecodable text passes: only its survivors are sent to Python."""
    body = strip(col)
    return F.coalesce(
        any_of(
            [
                col.contains("%"),
                col.contains("\\"),
                (F.length(body) >= 4) & body.rlike(r"^[A-Za-z0-9+/=\s]+$"),
            ]
        ),
        F.lit(False),
    )


def decode_payloads(df: DataFrame, text: str) -> DataFrame:
    """Adds ``decoded`` and ``decoding_chain``. One scan: plain rows cross to Python as a null, not as text."""
    short_batches(df.sparkSession)
    peeled = df.withColumn("_p", _peel_batch(F.when(maybe_encoded(F.col(text)), F.col(text))))
    return peeled.select(
        *df.columns,
        F.coalesce("_p.text", text).alias("decoded"),
        F.col("_p.chain").alias("decoding_chain"),
    )


# --- single decoders as expressions, for when only one layer is wanted ---------------
def decode_url(col: Column) -> Column:
    """Percent decoding; ``+`` stays, malformed input stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(col, r"\+", "%2B")), col)


def _printable_text(data: Column) -> Column:
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    return F.when(~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), text)


def decode_base64(col: Column) -> Column:
    body = F.regexp_replace(col, r"\s+", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    ok = (F.length(strip(col)) >= 4) & body.rlike(r"^[A-Za-z0-9+/=]+$")
    return F.when(ok, _printable_text(F.try_to_binary(padded, F.lit("base64"))))


def decode_hex(col: Column) -> Column:
    body = F.regexp_replace(col, r"\s+", "")
    ok = (F.length(body) >= 4) & (F.length(body) % 2 == 0) & body.rlike("^[0-9a-fA-F]+$")
    return F.when(ok, _printable_text(F.try_to_binary(body, F.lit("hex"))))
