"""Small tables and brute-force versions for the operators' tests."""
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def documents(spark, texts, extra=False):
    """texts: id -> text, or rows (id, text, source)."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] if isinstance(texts, dict) else [
        (k, t, "en", s, len(t or "")) for k, t, s in texts]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", "'x' AS size", "1 AS n", "2 AS word", "3 AS start", "array(1) AS prefix", "5 AS row", "7 AS gram") if extra else df
