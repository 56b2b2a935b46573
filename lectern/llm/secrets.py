"""Secret scans with corpus-wide ownership frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_maybe


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Patterns of the base kinds, in the order that ranks them.
KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run too short to count ends where its class ends, so that asking for the
#: least length in the pattern finds the same spans; this doesn't hold for ASSIGN.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that may be credentials without saying so: a long run of letters and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value is its owner's own if one owner, or one repository, holds it, and at most MOST_REPOS repositories do.
MOST_OWNERS, MOST_REPOS = 1, 10


def find_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of leftmost non-overlapping matches, counted in code points."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        return F.struct(
            end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["1"].alias("found")))).alias("out")
        )

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("0"), m.alias("1")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _valued(spans: Column, kind: str, value: Column | None = None) -> Column:
    """Spans as (start, rank, end, hash of the value); `value` is a function of the text found."""
    of = value or (lambda x: x)
    rank = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.md5(of(s["found"])).alias("hash")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def live_looking(token: Column) -> Column:
    """Letters, at least three digits, ten different characters, and no word that marks an example."""
    return (
        token.rlike("[A-Za-z]") & token.rlike("[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(token, ""))) >= 10)
        & ~token.rlike("(?i)example|sample|dummy|placeholder|xxxx")
    )


def candidates(text: Column, base: Column) -> Column:
    """Tokens that look live and lie outside the base spans, as spans of the kind `owned`."""
    free = F.filter(
        find_spans(text, TOKEN),
        lambda c: live_looking(c["found"]) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return _valued(free, "owned")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash: hash, repos, owners.

    found: hash, repo, owner.  Each step pre-aggregates, so a value that a
    third of all rows holds is a few rows a task when it shuffles.  A null
    owner is an owner of its own.  A repository that several owners hold (a
    copied document) counts once.
    """
    pairs = found.select("hash", "owner", "repo").distinct()
    repos = pairs.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repos"), F.lit(0).alias("owners"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.lit(0).alias("repos"), F.count(F.lit(1)).alias("owners"))
    return repos.unionByName(owners).groupBy("hash").agg(F.max("repos").alias("repos"), F.max("owners").alias("owners"))


def own(most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> Column:
    """Whether a value is its owner's own, by the columns of `ownership`; else it is a copied example."""
    return (F.least("owners", "repos") <= most_owners) & (F.col("repos") <= most_repos)


def secret_scan(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS
) -> DataFrame:
    """Spans of secrets in every row of docs.

    Returns doc_id, text_key (xxhash64 of the text), n_assign, n_access, n_hex,
    n_live, n_copied and spans, an array of (start, rank, end) in order, where
    rank is the place in KINDS and offsets are code points, end exclusive.  The
    values of all spans are counted over the corpus by distinct repositories
    (documents, equal texts once) and owners (sources): one that `own` accepts
    is live, any other a copied example.  The three base kinds stay in spans
    either way; a candidate token outside them becomes a span `owned` only if
    live.  n_live and n_copied count the base spans and candidates of either
    sort.  Null and empty texts have no span, texts of any length are read
    whole; rows that repeat are answered row by row and count as one
    repository.  Without rows the result is empty.  Further columns are not
    read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns(
        {
            "assign": _valued(F.filter(find_spans(F.col("t"), ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12), "assign",
                              lambda x: F.regexp_extract(x, ASSIGN, 2)),
            "access": _valued(find_spans(F.col("t"), ACCESS), "access"),
            "hex": _valued(find_spans(F.col("t"), HEX), "hex"),
        }
    ).withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("t").alias("text_key"), "owner", "base", candidates(F.col("t"), F.col("base")).alias("free")
    )
    rows = materialize(rows, "secrets")
    both = F.concat("base", "free")
    found = rows.where(F.size(both) > 0).select("rid", "owner", F.col("text_key").alias("repo"), F.explode(both).alias("c")).select("rid", "owner", "repo", "c.*")
    verdict = ownership(found).select("hash", own(most_owners, most_repos).alias("live"))
    judged = (
        found.join(verdict, "hash").groupBy("rid")
        .agg(F.collect_list(F.struct("start", "rank", "end", "live")).alias("judged"))
    )
    full = rows.select("rid", "doc_id", "text_key").join(judged, "rid", "left").withColumn("judged", F.coalesce("judged", F.array()))
    count = lambda k: F.size(F.filter("judged", lambda s: s["rank"] == KINDS.index(k))).cast("bigint")
    shown = F.filter("judged", lambda s: s["live"] | (s["rank"] < len(KINDS) - 1))
    spans = F.array_sort(F.transform(shown, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return full.select(
        "doc_id", "text_key", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.size(F.filter("judged", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("bigint").alias("n_copied"), spans.alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The spans as strings: base_sha256 and spans."""
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.withColumns({"base_sha256": F.sha2(_joined(base), 256), "spans": _joined(F.col("spans"))}).drop("text_key")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span of secret_scan replaced by `mark`.

    Overlapping spans become one mark.  Null texts stay null, empty and clean
    ones as they are; equal rows are treated alike; without rows the result is
    empty.  A text may be of any length, and further columns stay, whatever
    their names.  Spans come from secret_scan; only texts of ids that may have
    spans shuffle to meet them.
    """
    found = materialize(secret_scan(docs, doc_id=doc_id, text=text, owner=owner).where(F.size("spans") > 0), "found-secrets")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans").dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    rows = with_maybe(rows, found.select("_id"), "_id").withColumnRenamed("_id", "_doc")
    met = rows.where("_maybe").join(
        found.hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("_t", F.lit(""))) == F.col("_key")), "left"
    )
    t = F.col("_t")

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return (
            F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), out.alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, F.length(t))))
    clean = F.when(F.col("spans").isNull(), t).otherwise(clean)
    done = met.select(F.col("_row").withField(text, clean).alias("_row")).select("_row.*")
    return done.unionByName(rows.where("not _maybe").select("_row.*"))
