"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credentials of fixed forms (the base kinds) and for other strings that may be credentials.
The value of each candidate is hashed, and over the whole corpus the hashes are counted by distinct repositories and
distinct owners. A value that many owners hold, or that several owners hold in many repositories, is an example that is
copied around; one that stays with its owner looks live, in however many repositories of theirs. Base spans always
stay; a span of another kind is a finding only if its value is not widely copied.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm.runtime import lookup_join, ship, written

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "vendor", "random")
#: A value that this many owners hold, or two owners or more in this many repositories, counts as widely copied.
COPIED_OWNERS, COPIED_REPOS = 3, 20
#: Base kinds: fixed values of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Further kinds.
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[^-]|-(?!----))*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
VENDOR = re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|glpat-|AIza)[A-Za-z0-9_-]{16,}")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Bits a character that a string of the last kind needs; it must mix lower case, upper case and digits as well.
ENTROPY = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the other kinds that do not lie inside a base span."""
    out = []
    if "PRIVATE KEY" in text:
        out += [(m.start(), 3, m.end(), m[0]) for m in PRIVATE_KEY.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end(), m[0]) for m in WEB_TOKEN.finditer(text)]
    out += [(m.start(), 5, m.end(), m[0]) for m in VENDOR.finditer(text)]
    for m in RANDOM.finditer(text):
        v = m[0]
        if any(c.islower() for c in v) and any(c.isupper() for c in v) and any(c.isdigit() for c in v) and entropy(v) >= ENTROPY:
            out.append((m.start(), 6, m.end(), v))
    # a span meets a base span if of those that start before its end one ends after its start
    starts = [b[0] for b in base]
    ends = [0, *itertools.accumulate((b[2] for b in base), max)]
    kept, upto = [], 0
    for span in sorted(out):
        if span[0] >= upto and ends[bisect.bisect_left(starts, span[2])] <= span[0]:
            upto = span[2]
            kept.append(span)
    return kept


def listed(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


CANDIDATE = "struct<start: bigint, kind: int, end: bigint, value: bigint>"


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(id, repo, owner, n_assign, n_access, n_hex, base_sha256, candidates) of every row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    candidate = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans = sorted(base + further_spans(text, base))
                found.append([{"start": s, "kind": k, "end": e, "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(found, candidate)], names=["id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])

    rows = docs.select(F.col(id_col), F.col(text_col), F.col(repo_col).cast("string"), F.col(owner_col).cast("string")).toDF("id", "text", "repo", "owner")
    return rows.mapInArrow(run, f"id {kind}, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, candidates array<{CANDIDATE}>")


def ownership(rows: DataFrame) -> DataFrame:
    """(value, repos, owners): distinct repositories and owners of every candidate value. Null counts as one of each.

    Repeats are added up before each shuffle, first within (value, owner, repository), then within (value, owner), so
    a value that a third of all rows hold comes as a few rows of each task.
    """
    each = rows.select("repo", "owner", F.explode("candidates.value").alias("value"))
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    spans lists the base spans and, of the other kinds, those whose value is not widely copied, as kind:start:end in
    code points. Widely copied is what `copied_owners` owners hold, or two owners in `copied_repos` repositories. n_live
    and n_copied count the candidates of either sort, base ones too. Values are told apart by 64-bit hashes and are not
    kept. A repository is counted once for each of its owners. Null texts are empty; empty texts have no spans; a null
    repository or owner counts as one. Repeated rows get a row each, but are one repository; other columns are ignored,
    whatever their names; an empty table gives an empty result. Very long texts are scanned in time that grows with
    their length, and in memory a few times as large.
    """
    rows = written(scan(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    widely = (F.col("owners") >= copied_owners) | (F.col("owners") > 1) & (F.col("repos") >= copied_repos)
    copied = written(ownership(rows).where(widely).select("value", F.lit(True).alias("copied")), "copied")
    each = rows.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = lookup_join(each, copied, ["value"]).withColumn("copied", F.coalesce("copied", F.lit(False)))
    shown = F.when((F.col("kind") < 3) | ~F.col("copied"), F.struct("start", "kind", F.col("end")))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(shown)).alias("shown"), F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("shown", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    by_row = by_row.select("row", text.alias("spans"), "n_live", "n_copied")
    joined = rows.drop("candidates").join(by_row, "row", "left")
    return joined.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
