"""URL filters: host and path rules, and a blocked Bloom filter before an exact hash join.

A rule is a host with a path prefix; it fits the host and its subdomains, and the longest fitting rule decides. A
url without a rule is looked up by its canonical form in a list: a Bloom filter of blocks (one block of eight longs
a url) lets possible hits through to an exact hash join, which removes the filter's false positives.

The filter has a power of two of blocks, about ``BITS_PER_URL`` bits for each listed url, and at most
``MAX_BLOCKS``, so what is broadcast is bounded; a fuller filter lets more rows through to the join, which stays
exact. One url may have a large share of the rows: keys with many possible hits are counted, and only they are salted.

Null urls and urls without ``://``: host and path empty, no rule, no canonical form, allowed. Repeated rows: each
is judged. Empty tables or lists: nothing is blocked by the list. Other columns are kept; result columns whose
names the table has get the prefix ``_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_name

#: Rules of the production filter, as (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
WORDS = 8
BITS_PER_URL = 12
HASHES = 6
#: 2^19 blocks of eight longs: 32 MB of bits, enough for 22 million listed urls.
MAX_BLOCKS = 1 << 19
#: Rules become one expression; a longer list belongs in the url list.
MAX_RULES = 2_000
#: A key with more possible hits than this is hot: its hits are dealt to so many tasks, and only its listed url is copied.
HOT_HITS, SALTS = 50_000, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(url: Column) -> Column:
    """Host without user, port and ``www.``, path without a closing ``/``, and the sorted query without tracking; null if no ``://``.

    The scheme and the fragment do not count. Paths keep their case.
    """
    host, path = host_and_path(url)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", ""), r"\A(?:www\.)?(.*?)\.?\z", "$1")
    rest = F.substr(url, F.locate("://", url) + 3)
    query = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"\A(?:utm_[^=]*|gclid|fbclid|ref)(?:=|\z)"))
    joined = F.array_join(F.array_sort(pairs), "&")
    whole = F.concat(bare, F.regexp_replace(path, r"/+\z", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))
    return F.when(F.locate("://", url) > 0, whole)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an expression takes {MAX_RULES}")
    order = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    name = reduce(lambda acc, r: F.when(fits(r), F.lit(r[0] + r[1])).otherwise(acc), order, F.lit(None).cast("string"))
    verdict = reduce(lambda acc, r: F.when(fits(r), F.lit(r[2])).otherwise(acc), order, F.lit(None).cast("string"))
    return name, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and, for each word of a block, the bits it sets."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(h, F.lit(blocks))
    bits = [F.shiftrightunsigned(g, 9 * i).bitwiseAND(F.lit(511)) for i in range(HASHES)]
    words = []
    for w in range(WORDS):
        set_ = [F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for b in bits]
        words.append(reduce(lambda x, y: x.bitwiseOR(y), set_))
    return block, words


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: rows (block, w0 .. w7), only blocks that are not empty."""
    block, words = _place(F.col(key), blocks)
    parts = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def blocks_for(n: int) -> int:
    need = max(1, n * BITS_PER_URL // (64 * WORDS))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def in_list(df: DataFrame, key: str, listed: DataFrame, out: str = "listed") -> DataFrame:
    """All rows with a boolean: whether ``key`` is among the column ``key`` of ``listed``; a null key is not."""
    hit, block, salt = (free_name(df, n) for n in ("_hit", "_block", "_salt"))
    own = listed.select(F.col(key).alias("lk")).where("lk is not null")
    n = own.agg(F.approx_count_distinct("lk")).first()[0]
    if not n:
        return df.withColumn(out, F.lit(False))
    blocks = blocks_for(n)
    table = bloom(own, "lk", blocks).withColumnRenamed("block", "fb")
    at, words = _place(F.col(key), blocks)
    # at most MAX_BLOCKS rows of nine longs
    probed = df.withColumn(block, at).join(F.broadcast(table), F.col(block) == F.col("fb"), "left")
    passes = reduce(lambda x, y: x & y, [F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(words)])
    probed = probed.withColumn(hit, F.coalesce(passes & F.col("fb").isNotNull(), F.lit(False))).select(*df.columns, hit)
    clear = probed.where(~F.col(hit)).drop(hit).withColumn(out, F.lit(False))
    hits = probed.where(F.col(hit)).drop(hit)
    # at most a row for each HOT_HITS hits
    hot = F.broadcast(hits.groupBy(F.col(key).alias("hk")).agg(F.count("*").alias("hn")).where(F.col("hn") > HOT_HITS).select("hk"))
    dealt = F.when(F.col("hk").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = hits.join(hot, F.col(key) == F.col("hk"), "left").withColumn(salt, dealt).drop("hk")
    copies = F.sequence(F.lit(0), F.when(F.col("hk").isNotNull(), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    exact = own.distinct().join(hot, F.col("lk") == F.col("hk"), "left").withColumn("ls", F.explode(copies)).drop("hk")
    found = salted.join(exact, (F.col(key) == F.col("lk")) & (F.col(salt) == F.col("ls")), "left")
    return clear.unionByName(found.withColumn(out, F.col("lk").isNotNull()).drop("lk", "ls", salt))


def judge(df: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """All rows with host, path, rule, canonical_url and verdict (allow or block).

    ``listed`` has blocked urls in its column ``url``; they are compared in canonical form. A rule goes before the list.
    """
    names = {n: free_name(df, n) for n in ("host", "path", "rule", "verdict", "canonical_url")}
    address = F.col(f"`{url}`").cast("string")
    host, path = host_and_path(address)
    flat = df.withColumns({names["host"]: host, names["path"]: path, names["canonical_url"]: canonical(address)})
    name, verdict = rule_of(F.col(names["host"]), F.col(names["path"]), rules)
    flat = flat.withColumns({names["rule"]: name, names["verdict"]: verdict})
    blocked = listed.select(canonical(F.col("url").cast("string")).alias(names["canonical_url"]))
    mark = free_name(flat, "listed")
    judged = in_list(flat, names["canonical_url"], blocked, mark)
    by_list = F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn(names["verdict"], F.coalesce(F.col(names["verdict"]), by_list)).drop(mark)


#: The list of the registered query: the pages whose page_id this divides.
LIST_EVERY = 50


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all pages, by RULES and by the list of the urls of every LIST_EVERY-th page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(F.col("page_id") % LIST_EVERY == 0).select("url")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canonical_url")


_HOST = "coalesce(translate(regexp_extract(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_REST = "case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end"

ORACLE = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *,
  CASE WHEN position('://' in url) > 0 THEN
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^(?:www\\.)?(.*?)\\.?$', '\\1')
    || regexp_replace(path, '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
         string_split(regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|gclid|fbclid|ref)(?:=|$)'))), '&'), ''), '')
  END AS canonical_url FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c),
l AS (SELECT DISTINCT canonical_url AS u FROM c WHERE page_id % {LIST_EVERY} = 0 AND canonical_url IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical_url IN (SELECT u FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  canonical_url
FROM r
"""
