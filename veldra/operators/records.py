"""Records of indexed files and rule documents: what is reused, counted, looked up and cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names of settings that hold a database's address, its drivers, and what a database secret is
DB_ENV = "(?i)(mongo|database|db)_?(uri|url)"
DB_DRIVERS = ("mongoose", "mongodb")
STATUSES = ("indexed", "recorded", "unparsed")


def reused(walked: DataFrame, previous: DataFrame, version: int) -> DataFrame:
    """walked (project, path, hash, kind, action) with ``reused``: whether the row of the last run (project, path, hash, kind,
    version) still holds: equal hash and kind, made by this version, and not to be skipped."""
    old = previous.select("project", "path", *[F.col(c).alias(f"__{c}") for c in ("hash", "kind", "version")]).dropDuplicates(["project", "path"])
    same = (F.col("hash") == F.col("__hash")) & (F.col("kind") == F.col("__kind")) & (F.col("__version") == version) & (F.col("action") != "skip")
    return walked.join(old, ["project", "path"], "left").withColumn("reused", F.coalesce(same, F.lit(False))).drop("__hash", "__kind", "__version")


def to_reindex(changed: DataFrame, changed_links: DataFrame, removed: DataFrame) -> DataFrame:
    """(path): every path of the three once."""
    return changed.select("path").union(changed_links.select("path")).union(removed.select("path")).distinct()


def file_stats(files: DataFrame, counted: list[str]) -> DataFrame:
    """One row a project: files, files of each status (any other is skipped), and sums of ``counted`` over indexed files."""
    is_ = lambda s: F.col("status") == s
    other = F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True))
    sums = [F.coalesce(F.sum(F.when(is_("indexed"), F.col(c))), F.lit(0)).cast("long").alias(c) for c in counted]
    return files.groupBy("project").agg(F.count("*").alias("files"), *[F.count_if(is_(s)).alias(s) for s in STATUSES], F.count_if(other).alias("skipped"), *sums)


def installed(deps: DataFrame, lock: DataFrame, present: DataFrame) -> DataFrame:
    """deps (dir, name) with ``installed``: the version in the lock (dir, name, place, version) under ``packages``, else under
    ``dependencies``, else that of the package (dir, name, version) in the directory; null if none says."""
    rank = F.when(F.col("place") == "packages", 0).otherwise(1)
    said = lock.where("version IS NOT NULL").withColumn("rank", rank).unionByName(present.where("version IS NOT NULL").select("dir", "name", F.lit(None).cast("string").alias("place"), "version", F.lit(2).alias("rank")))
    best = said.groupBy("dir", "name").agg(F.min_by("version", F.struct("rank", "version")).alias("installed"))
    return deps.join(best, ["dir", "name"], "left")


def databases(deps: DataFrame, env_reads: DataFrame, secrets: DataFrame, models: DataFrame) -> DataFrame:
    """(project, drivers, connection_env, credentials_in_url) of projects with a driver among their deps or a model.

    deps: (project, name), env_reads: (project, name), secrets: (project, kind, name), models: (project, model).
    """
    nothing = F.lit(None).cast("string")
    row = lambda df, driver, env, secret, counts: df.select("project", driver.alias("driver"), env.alias("env"), secret.alias("secret"), F.lit(counts).alias("counts"))
    address = F.col("name").rlike(DB_ENV)
    shown = (F.col("kind") == "connection-string") | ((F.col("kind") == "env-file-secret") & address)
    no = F.lit(False)
    rows = row(deps.where(F.col("name").isin(*DB_DRIVERS)), F.col("name"), nothing, no, True).union(row(models, nothing, nothing, no, True))
    rows = rows.union(row(env_reads.where(address), nothing, F.col("name"), no, False)).union(row(secrets, nothing, nothing, F.coalesce(shown, no), False))
    names = lambda c: F.array_sort(F.collect_set(c)).alias
    made = rows.groupBy("project").agg(names("driver")("drivers"), names("env")("connection_env"), F.bool_or("secret").alias("credentials_in_url"), F.bool_or("counts").alias("counts"))
    return made.where("counts").drop("counts")


def named_apart(functions: DataFrame) -> DataFrame:
    """functions (file, name, line, col) with ``unique``: the name, from its second place in the file on with ``@line:col``;
    functions without a name are ``anon@line:col``."""
    at = F.concat(F.lit("@"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"))
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "col"))
    return functions.withColumn("unique", F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("anon"), at)).when(nth > 1, F.concat("name", at)).otherwise(F.col("name")))


def max_weight(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """(finding, weight): the greatest weight of the assets (id, weight) among a finding's nodes (finding, node), at least 0."""
    hit = findings.join(assets.select(F.col("id").alias("node"), "weight"), "node", "left")
    return hit.groupBy("finding").agg(F.greatest(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"))


def sections(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, name, text): the parts under ``## name`` lines outside code fences, in order; what precedes the first is left out."""
    lines = documents.select(key, F.posexplode(F.split(body, "\n")).alias("at", "line"))
    so_far = Window.partitionBy(key).orderBy("at")
    fenced = F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(so_far) % 2 == 1
    head = F.when(~F.col("fenced"), F.regexp_extract("line", r"^## (.+?)\s*$", 1))
    marked = lines.withColumn("fenced", fenced).withColumn("head", F.nullif(head, F.lit("")))
    numbered = marked.withColumn("pos", F.count("head").over(so_far)).where("pos > 0")
    parts = numbered.groupBy(key, "pos").agg(F.max("head").alias("name"), F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("at", "line")))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), r"^\s+|\s+$", "")
    return parts.select(key, "pos", "name", text.alias("text"))


def section_problems(parts: DataFrame, key: str, wanted: list[str], shortest: int = 40) -> DataFrame:
    """(key, problem) of documents whose ``sections`` aren't those wanted, in order, or have a text below ``shortest`` characters."""
    made = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("got"), F.count_if(F.length("text") < shortest).alias("short"))
    other = F.transform("got", lambda g: g["name"]) != F.array(*map(F.lit, wanted))
    problem = F.when(other, F.concat(F.lit("sections: "), F.array_join(F.transform("got", lambda g: g["name"]), " | "))).when(F.col("short") > 0, F.lit("a section is too short"))
    return made.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def tags(names: Column) -> Column:
    """Tags of a project by the names of its packages; without a manifest (null) the usual ones."""
    has = lambda *known: F.arrays_overlap(names, F.array(*map(F.lit, known)))
    tag = lambda when, name: F.when(when, F.lit(name))
    found = F.array(
        tag(has("express"), "Express"), tag(has("react", "react-dom"), "React"), tag(has("mongoose", "mongodb"), "MongoDB"), tag(has("next"), "Next.js"), F.when(has("typescript"), F.lit("TypeScript")).otherwise(F.lit("Node.js"))
    )
    return F.when(names.isNull(), F.array(*map(F.lit, ("Express", "Node.js", "MongoDB")))).otherwise(F.array_compact(found))


def front_matter(documents: DataFrame, key: str, text: str) -> DataFrame:
    """documents with ``meta`` (map of names to texts, lists as JSON arrays), ``body`` and ``meta_problem``.

    A document begins with ``---``, lines of names and values, and ``---``. Values are scalars, quoted or not; ``[a, b]``; or ``- a`` lines below an
    empty value. Lines that are none of these, names given twice, and a block that never ends are problems; a document
    without a block has an empty map.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n", "\n")
    opened = t.rlike(r"^---[ \t]*\n")
    end = r"(?s)^---[ \t]*\n(.*?)(?:\n|^|(?<=\n))---[ \t]*(?:\n(.*))?$"
    closed = opened & t.rlike(end)
    block = F.when(closed, F.regexp_extract(t, end, 1)).otherwise("")
    # a list below its name is written on the name's line, so that each line says all
    joined = F.regexp_replace(block, r"\n[ \t]*-[ \t]+", "\u0001")
    lines = F.filter(F.split(joined, "\n"), lambda x: ~x.rlike(r"^[ \t]*(#.*)?$"))
    named = r"^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:[ \t]*(.*)$"
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\"(.*)\"$", "$1"), r"^'(.*)'$", "$1")

    def value(raw: Column) -> Column:
        below = F.filter(F.split(raw, "\u0001"), lambda x: F.trim(x) != "")
        flow = F.filter(F.split(F.regexp_replace(raw, r"^\[|\][ \t]*$", ""), ","), lambda x: F.trim(x) != "")
        as_list = lambda xs: F.to_json(F.transform(xs, bare))
        plain = bare(F.regexp_replace(raw, r"[ \t]+#.*$", ""))
        return F.when(raw.contains("\u0001"), as_list(below)).when(raw.rlike(r"^\[.*\][ \t]*$"), as_list(flow)).when(raw.rlike(r"^[\"'].*[\"'][ \t]*$"), bare(raw)).otherwise(plain)

    entry = lambda x: F.struct(F.regexp_extract(x, named, 1).alias("key"), value(F.regexp_extract(x, named, 2)).alias("value"))
    entries = F.transform(F.filter(lines, lambda x: x.rlike(named)), entry)
    odd = F.get(F.filter(lines, lambda x: ~x.rlike(named)), F.lit(0))
    names = F.transform(entries, lambda e: e["key"])
    twice = F.get(F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1), F.lit(0))
    problem = F.when(opened & ~closed, "front matter never ends").when(odd.isNotNull(), F.concat(F.lit("no name and value: "), odd)).when(twice.isNotNull(), F.concat(F.lit("given twice: "), twice))
    first = F.map_from_entries(F.filter(entries, lambda e: F.lit(True)))
    return documents.withColumns(
        {"meta": F.when(twice.isNull(), first).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), "body": F.when(closed, F.coalesce(F.regexp_extract(t, end, 2), F.lit(""))).otherwise(t), "meta_problem": problem}
    )


def rule_documents(documents: DataFrame, path: str, text: str, wanted: dict[str, list[str]], needed: tuple[str, ...] = ("type", "title", "kind"), shortest: int = 40) -> tuple[DataFrame, DataFrame]:
    """(rules, problems) of rule documents: (type, kind, meta, hash, version, file), and (file, problem), the first of each file.

    A document needs the names in ``needed``, a type that is its file's name, the sections that its kind wants, in order and not too short,
    and a type that no other document has. A rule's version is the beginning of its content's hash.
    """
    read = front_matter(documents.select(F.col(path).alias("file"), F.col(text).alias("raw")), "file", "raw")
    got = sections(read.where(F.col("meta_problem").isNull()), "file", "body")
    listed = got.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.length("text").alias("size")))).alias("parts"))
    rows = read.join(listed, "file", "left").withColumns({"type": F.try_element_at("meta", F.lit("type")), "kind": F.try_element_at("meta", F.lit("kind"))})
    names = F.coalesce(F.array_join(F.transform("parts", lambda p: p["name"]), " | "), F.lit("none"))
    short = F.get(F.filter("parts", lambda p: p["size"] < shortest), F.lit(0))["name"]
    absent = F.get(F.filter(F.array(*map(F.lit, needed)), lambda n: F.coalesce(F.try_element_at("meta", n), F.lit("")) == ""), F.lit(0))
    order = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, " | ".join(v))])
    right = F.try_element_at(order, F.col("kind"))
    twice = F.count("*").over(Window.partitionBy("type")) > 1
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.md$", "")
    problem = (
        F.when(F.col("meta_problem").isNotNull(), F.col("meta_problem"))
        .when(absent.isNotNull(), F.concat(F.lit("absent: "), absent))
        .when(right.isNull(), F.concat(F.lit("no such kind: "), "kind"))
        .when(F.col("type") != base, F.concat(F.lit("type isn't the file's name: "), "type"))
        .when(names != right, F.concat(F.lit("sections: "), names))
        .when(short.isNotNull(), F.concat(F.lit("too short: "), short))
    )
    rows = rows.withColumn("problem", problem)
    rows = rows.withColumn("problem", F.when(F.col("problem").isNull() & twice, F.concat(F.lit("given twice: "), "type")).otherwise(F.col("problem")))
    hash_ = F.sha1("raw")
    good = rows.where("problem IS NULL").select("type", "kind", "meta", hash_.alias("hash"), F.substring(hash_, 1, 8).alias("version"), "file")
    return good, rows.where("problem IS NOT NULL").select("file", "problem")


def chosen_sections(parts: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """The sections with these names, or all."""
    return parts if chosen is None else parts.where(F.col("name").isin(chosen))
