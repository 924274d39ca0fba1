"""Small tables and plain Python versions the tests compare with."""
import hashlib
import re

SF_SMALL = "/root/testdata/sf0.001"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def sample_texts(spark):
    return [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)
