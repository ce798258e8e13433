"""Plain versions of rules that several operators share."""

import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNSPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(lower(text))


def unspaced(text):
    return UNSPACED.findall(lower(text))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def table(spark, name, small="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{small}/{name}.parquet")
