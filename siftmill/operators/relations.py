"""Edges between files: copies, versions, mentions, imports, shared topics, superseded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import fixed as X
from ..session import spread

C = F.col

CONFIDENCE = {"duplicates": 1.0, "versioned": 0.85, "references": 0.7, "depends_on": 0.8, "supersedes": 0.65}
#: Characters of a name before its last dot, and behind it, by which names meet texts.
BEFORE_DOT, BEHIND_DOT = 16, 1
SHORTEST_NAME = 5
#: Characters of an instant's text up to its hour.
HOUR = 13


def edges(source: Column, target: Column, kind: str, confidence: Column | None = None) -> list[Column]:
    return [source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), (F.lit(CONFIDENCE.get(kind)) if confidence is None else confidence).alias("confidence")]


def duplicates(files: DataFrame) -> DataFrame:
    """A star for each digest: its smallest id to all others."""
    keyed = files.select("id", P.digest(C("sha256")).alias("digest")).where("digest is not null")
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"))
    return keyed.join(first, "digest").where("id <> first").select(*edges(C("first"), C("id"), "duplicates"))


def versioned(files: DataFrame) -> DataFrame:
    """Chains from older to newer files of one stem, by the first version mark that two of them or more carry."""
    marks = [F.when(C("filename").rlike(p), F.lit(i)) for i, p in enumerate(X.VERSIONS)]
    each = files.select("id", F.coalesce("modified_at", F.lit("")).alias("at"), P.version_stem(C("filename")).alias("stem"), F.explode(F.array_compact(F.array(*marks))).alias("mark"))
    several = each.groupBy("stem", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("stem").agg(F.min("mark").alias("mark"))
    # a stem's chain is made within hours and then from each hour to the next, so a common stem isn't one group
    rows = each.join(several, ["stem", "mark"]).select("id", "at", "stem", F.substring("at", 1, HOUR).alias("hour"))
    within = F.lead("id").over(Window.partitionBy("stem", "hour").orderBy("at", "id"))
    first = rows.groupBy("stem", "hour").agg(F.min(F.struct("at", "id")).alias("f"))
    following = first.select("stem", "hour", F.lead("f.id").over(Window.partitionBy("stem").orderBy("hour")).alias("later"))
    chained = rows.withColumn("next", within).join(following, ["stem", "hour"]).select("id", F.coalesce("next", "later").alias("next"))
    return chained.where("next is not null").select(*edges(C("id"), C("next"), "versioned"))


def anchors(text: Column) -> Column:
    """What stands around each dot of a text: up to ``BEFORE_DOT`` characters before it and ``BEHIND_DOT`` behind."""
    parts = F.split(text, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)),
        lambda i: F.struct(F.substring(F.element_at(parts, i), -BEFORE_DOT, BEFORE_DOT).alias("before"), F.substring(F.coalesce(F.try_element_at(parts, i + 1), F.lit("")), 1, BEHIND_DOT).alias("behind")),
    )


def references(files: DataFrame) -> DataFrame:
    """Files whose text names another file to every file of that name: the ``mentions``, once for each file."""
    named = files.select(C("id").alias("target"), F.lower("filename").alias("name"))
    return mentions(files).join(named, "name").where("source <> target").select(*edges(C("source"), C("target"), "references"))


def mentions(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(source, name): names of other files (in lower case, five characters or more) that occur in a text in any letter case.

    A name can only occur where its last dot and what surrounds it occur, so names and texts are joined on these few
    characters and compared in full after that: no pair that doesn't share them is ever made. Names of fewer than sixteen
    characters before the dot use what there is; names without a dot meet texts on their first five characters.
    """
    names = files.select(F.lower("filename").alias("name")).where(F.length("name") >= SHORTEST_NAME).distinct()
    texts = spread((files if texts is None else texts).where(F.length("content_sample") > 0).select("id", "content_sample", "filename"), "id").select(C("id").alias("source"), F.lower("content_sample").alias("text"), F.lower("filename").alias("own"))

    stem, ext = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1), F.regexp_extract("name", r"\.([^.]*)$", 1)
    last = F.substring_index(stem, ".", -1)
    dotted = names.where(C("name").contains(".")).select("name", F.substring(last, -BEFORE_DOT, BEFORE_DOT).alias("before"), F.substring(ext, 1, BEHIND_DOT).alias("behind"), (F.length(last) >= BEFORE_DOT).alias("full"))
    spots = texts.where(C("text").contains(".")).select("source", F.explode(F.array_distinct(anchors(C("text")))).alias("x")).select("source", "x.before", "x.behind")
    # a short part before the dot may follow anything, and nothing may stand behind it: the ends that some name has are offered
    lengths = sorted(r["n"] for r in dotted.select(F.length("before").alias("n")).distinct().collect())
    ends = spots.select("source", F.explode(F.array_distinct(F.array(*[F.right("before", F.lit(n)) if n else F.lit("") for n in lengths or [0]]))).alias("before"), "behind")
    ends = ends.select("source", "before", F.explode(F.array_distinct(F.array("behind", F.lit("")))).alias("behind"))
    met = ends.join(dotted, ["before", "behind"]).select("source", "name")
    plain = names.where(~C("name").contains(".")).select("name", F.substring("name", 1, SHORTEST_NAME).alias("gram"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - SHORTEST_NAME + 1)), lambda i: F.substring(C("text"), i, F.lit(SHORTEST_NAME)))
    if not plain.isEmpty():
        met = met.unionByName(texts.select("source", F.explode(F.array_distinct(grams)).alias("gram")).join(plain, "gram").select("source", "name"))
    return met.distinct().join(texts, "source").where(C("text").contains(C("name")) & ((C("name") != C("own")) | C("own").isNull())).select("source", "name")


def depends_on(files: DataFrame, found: Column) -> DataFrame:
    """Importing files to the first file of their directory whose stem is the last part of an import; once for each import."""
    used = files.where(F.length("content_sample") > 0).select("id", "parent_dir", F.explode(found).alias("import"))
    last = F.element_at(F.split(F.lower(F.regexp_replace(F.regexp_replace(F.trim("import"), r"\.", "/"), "::", "/")), "/"), -1)
    stems = files.select(C("id").alias("target"), "parent_dir", F.lower(P.leaf_stem(C("filename"))).alias("stem"))
    # the first two ids of a stem suffice: the first that isn't the importing file
    first = stems.groupBy("parent_dir", "stem").agg(F.min("target").alias("one"), F.max("target").alias("greatest"))
    second = stems.join(first, ["parent_dir", "stem"]).where("target > one").groupBy("parent_dir", "stem").agg(F.min("target").alias("two"))
    firsts = first.join(second, ["parent_dir", "stem"], "left")
    target = F.when(C("one") != C("id"), C("one")).otherwise(C("two"))
    return used.select("id", "parent_dir", last.alias("stem"), "import").join(firsts, ["parent_dir", "stem"]).where(target.isNotNull()).select(*edges(C("id"), target, "depends_on"), "import")


def co_classified(classifications: DataFrame, least: int = 3, files_per_topic: int = 20) -> DataFrame:
    """Pairs of files that share ``least`` topics or more, of each topic its first ``files_per_topic`` files."""
    topic = classifications.select(F.concat_ws(":", "domain", "topic").alias("topic"), "file_id").distinct()
    place = F.row_number().over(Window.partitionBy("topic").orderBy("file_id"))
    few = topic.withColumn("place", place).where(C("place") <= files_per_topic).select("topic", "file_id")
    pairs = few.select("topic", C("file_id").alias("a")).join(few.select("topic", C("file_id").alias("b")), "topic").where("a < b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.array_join(F.slice(F.sort_array(F.collect_list("topic")), 1, 5), ", ").alias("topics")).where(C("shared") >= least)
    return shared.select(*edges(C("a"), C("b"), "co_classified", F.least(F.lit(1.0), F.round(C("shared") * 0.15, 2))), "topics")


def supersedes(files: DataFrame, classifications: DataFrame) -> DataFrame:
    """The newest file of a domain and stem to each strictly older one; files without a time or classification take no part."""
    best = classifications.groupBy("file_id").agg(F.max(F.struct(F.coalesce(C("score"), F.lit(0.0)).alias("s"), (-C("id")).alias("o"), C("domain"))).alias("b"))
    each = files.where(F.length("modified_at") > 0).join(best.select(C("file_id").alias("id"), C("b.domain").alias("domain")), "id").select("id", "modified_at", "domain", P.version_stem(C("filename")).alias("stem"))
    newest = each.groupBy("domain", "stem").agg(F.max(F.struct(C("modified_at"), (-C("id")).alias("o"), C("id"))).alias("m")).select("domain", "stem", C("m.id").alias("newest"), C("m.modified_at").alias("at"))
    return each.join(newest, ["domain", "stem"]).where("at > modified_at").select(*edges(C("newest"), C("id"), "supersedes"))


def in_degrees(files: DataFrame, found_imports: Column) -> DataFrame:
    """(file_id, references): how many files name or import each file. Names are counted before they meet their files."""
    named = mentions(files).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    by_name = files.select("id", F.lower("filename").alias("name")).join(named, "name").select("id", "n")
    imported = depends_on(files, found_imports).select(C("target_id").alias("id"), "source_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return by_name.unionByName(imported).groupBy("id").agg(F.sum("n").alias("references")).select(C("id").alias("file_id"), "references")


def edges_of(files: DataFrame, classifications: DataFrame, found_imports: Column, id: int) -> DataFrame:
    """All edges from and to one file, each relation made of the rows that can have a part in it only. ``id`` is one file's."""
    columns = ["source_id", "target_id", "kind", "confidence"]
    digest, stem, name, place = P.digest(C("sha256")), P.version_stem(C("filename")), F.lower("filename"), C("parent_dir")
    own = files.where(C("id") == id)
    me = own.select(digest.alias("digest"), stem.alias("stem"), name.alias("name"), place.alias("place")).first()
    if me is None:
        return duplicates(files.limit(0))
    around = files.where(stem == me["stem"])
    topic = F.concat_ws(":", "domain", "topic")
    shared = classifications.withColumn("__t", topic).join(classifications.where(C("file_id") == id).select(topic.alias("__t")).distinct(), "__t", "left_semi").drop("__t")
    rated = classifications.join(around.select(C("id").alias("file_id")), "file_id", "left_semi")
    text = F.lower("content_sample")
    naming = files.where((name.isNull() | (name != me["name"])) & text.contains(F.lit(me["name"]))) if len(me["name"] or "") >= SHORTEST_NAME else files.limit(0)
    named = mentions(files, own).join(files.select(C("id").alias("target"), name.alias("name")), "name").where("source <> target")
    parts = [
        duplicates(files.where(digest == me["digest"])), versioned(around), depends_on(files.where(place == me["place"]), found_imports).select(*columns), co_classified(shared).select(*columns), supersedes(around, rated),
        naming.where(C("id") != id).select(*edges(C("id"), F.lit(id).cast("long"), "references")), named.select(*edges(C("source"), C("target"), "references")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where((C("source_id") == id) | (C("target_id") == id))


def all_relations(files: DataFrame, classifications: DataFrame, found_imports: Column) -> DataFrame:
    columns = ["source_id", "target_id", "kind", "confidence"]
    parts = [duplicates(files), versioned(files), references(files), depends_on(files, found_imports).select(*columns), co_classified(classifications).select(*columns), supersedes(files, classifications)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
