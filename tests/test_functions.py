import pytest
from pyspark.sql import functions as F

from siftmill.functions import files as P
from siftmill.functions import text as T

C = F.col


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,want", [("  Hello,  WORLD!  ", "hello world"), ("No.Punctuation?Here!", "no punctuation here"), ("", ""), (None, None), ("Łódź 7", "d 7")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_text(C("t")), t=text) == want


def test_normalized_hash(spark):
    assert one(spark, T.normalized_hash(C("t")), t="Hello, World!") == one(spark, T.normalized_hash(C("t")), t="hello world")


def test_keyword_sets(spark):
    assert one(spark, T.keyword_set(C("t")), t="go to the Store the x1y größe") == ["the", "store", "größe"]
    a, b = F.split(C("a"), " "), F.split(C("b"), " ")
    assert one(spark, T.jaccard(a, b), a="hello world foo", b="hello world bar") == 0.5
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, a), a="x") == 0.0


def test_top_keywords(spark):
    df = spark.createDataFrame([(1, "Beta alpha alpha the beta x_1 gamma über"), (2, ""), (3, None)], "id long, t string")
    got = {r["id"]: r["keywords"] for r in T.top_keywords(df, "id", "t").collect()}
    assert got == {1: ["beta", "alpha", "x_1", "gamma"], 2: [], 3: []}


def test_code_keywords(spark):
    text = "import os.path\nfrom a import b\n  def run(x):\n    return await x\nclass K:\n"
    assert one(spark, T.code_keywords(C("t"), F.array(F.lit("z"))), t=text) == ["os.path", "a", "run", "K", "return", "await", "z"]


@pytest.mark.parametrize("secret,want", [("abcd", "****"), ("sk-1234567", "sk…67 (len=10)")])
def test_mask(spark, secret, want):
    assert one(spark, T.mask_secret(C("t")), t=secret) == want


def test_fingerprint(spark):
    assert one(spark, T.error_fingerprint(F.lit("OSError"), C("m")), m="line 12: 'a b' in /usr/lib/x.py") == "OSError::line N: STR in PATH"


def test_body_hash(spark):
    assert one(spark, T.body_hash(C("t")), t=" a  b\n c ") == one(spark, T.body_hash(C("t")), t="a b c")


@pytest.mark.parametrize("name,stem,mark", [("report_v1.0.docx", "report", 0), ("data_v2.docx", "data", 0), ("backup_20260227.csv", "backup", 1), ("notes_copy.txt", "notes", 2), ("file (1).txt", "file", 3), ("readme_rev3.md", "readme", 4), ("Normal.txt", "normal", None), (".env", ".env", None), ("a.tar.gz", "a.tar", None)])
def test_versions(spark, name, stem, mark):
    assert one(spark, P.version_stem(C("n")), n=name) == stem
    assert one(spark, P.version_pattern(C("n")), n=name) == mark


@pytest.mark.parametrize("text,days", [("2026-02-26T12:00:00Z", 1), ("2026-03-05T00:00:00Z", 0), ("n/a", 9999), (None, 9999), ("2026-13-45T00:00:00Z", 9999), ("2026-02-27T02:00:00+02:00", 1)])
def test_days(spark, text, days):
    assert one(spark, P.days_since(C("t"), F.lit("2026-02-28").cast("timestamp")), t=text) == days


@pytest.mark.parametrize("signature,extension,want", [("25504446aa", ".txt", "application/pdf"), ("7b226122", ".py", "application/json"), ("00", ".py", "text/x-python"), (None, ".zzz", "application/octet-stream"), (None, None, "application/octet-stream")])
def test_mime(spark, signature, extension, want):
    df = spark.createDataFrame([(signature, extension)], "s string, e string")
    kind, binary = df.select(P.mime(C("s"), C("e")).alias("m"), "e").select("m", P.is_binary(C("e"), C("m"))).first()
    assert kind == want and binary == (not want.startswith("text/") and want != "application/json")


def test_domain(spark):
    rows = [(".py", "/tax/a.py", "contract", ("PROG", 0.95)), (".txt", "/My Tax/a.txt", "contract", ("TAX", 0.85)), (".txt", "/x/a.txt", "The Contract", ("LG", 0.70)), (".txt", "/x/a.txt", None, ("UNKNOWN", 0.0)), (None, None, None, ("UNKNOWN", 0.0)), (".txt", "/x", "hipaa", ("UNKNOWN", 0.0))]
    df = spark.createDataFrame([r[:3] for r in rows], "e string, p string, c string")
    assert [tuple(r[0]) for r in df.select(P.domain(C("e"), C("p"), C("c"))).collect()] == [r[3] for r in rows]


@pytest.mark.parametrize("size,exact,whole", [(0, "0.0 B", "0.0 B"), (1536, "1.5 KB", "1.0 KB"), (39168, "38.2 KB", "38.0 KB"), (5 * 1024**4, "5.0 TB", "5.0 TB"), (3 * 1024**5, "3.0 PB", "3.0 PB")])
def test_sizes(spark, size, exact, whole):
    assert one(spark, P.human_size(C("s")), s=size) == exact and one(spark, P.human_size(C("s"), True), s=size) == whole


def test_places_and_policy(spark):
    assert one(spark, P.in_shared_place(C("p")), p=r"\\server\x") and one(spark, P.in_shared_place(C("p")), p="/a/Public/b") and not one(spark, P.in_shared_place(C("p")), p="/a/publicb")
    assert one(spark, P.in_encrypted_place(C("p")), p=r"C:\Vault\x") and not one(spark, P.in_encrypted_place(C("p")), p=None)
    policy = lambda p, **k: tuple(one(spark, P.allowed_path(C("p"), k.get("protected", [r"C:\Windows", "Recycle"]), k.get("allowed", [])), p=p))
    assert policy(r"c:\windows\system32")[0] is False and policy(r"C:\WindowsX")[0] is True and policy("/a/recycle.bin/x")[0] is False
    assert policy("/data/x", allowed=["/data"]) == (True, "ok") and policy("/other", allowed=["/data"])[0] is False and policy(None)[0] is False


def test_redaction(spark):
    got = one(spark, P.redacted_path(C("p")), p=r"C:\users\personal\secret.txt")
    assert got["protected"] and got["display_path"] == "[protected]/secret.txt" and len(got["path_id"]) == 20
    assert one(spark, P.redacted_path(C("p")), p=r"C:\a\b.txt")["display_path"] == "…/a/b.txt"
    assert one(spark, P.redacted_path(C("p")), p=None)["display_path"] == "unknown"
    assert one(spark, P.path_id(C("p")), p=r"C:\A\b") == one(spark, P.path_id(C("p")), p="c:/a/B")
    text = one(spark, P.without_paths(C("t")), t=r"See C:\a\b.txt, and D:\x\y.doc; done")
    assert "a\\b" not in text and text.startswith("See [path:") and text.endswith("]; done") and text.count("[path:") == 2


@pytest.mark.parametrize("text,want", [(" SHA256:" + "AB" * 32, "ab" * 32), ("0" * 64, None), ("n/a", None), (None, None)])
def test_digest(spark, text, want):
    assert one(spark, P.digest(C("s")), s=text) == want
