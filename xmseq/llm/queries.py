"""The queries of these operators on the given tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.llm import centroids, fingerprints, inverted, kneser_ney, language, lattice, lines, mixing, packing, phrases, substrings, suffixes, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney score of every document beside a unigram score, learnt from nine tenths of them."""
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


#: Weights of the tree's nodes; those not named weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables have no domain: the number of a source, modulo 3, stands for one."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    return docs.withColumn("domain", F.when(number != "", F.concat(F.lit("d"), number.cast("bigint") % 3)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of 60 % of all tokens reads each document."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(docs, F.expr("tokens * 6 div 10"), WEIGHTS, max_epochs=4, seed=1)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "uses")


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by its url and its aliases."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark, RULES))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of up to 1024 tokens."""
    import public_tokenizers

    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # The ids of a piece are stored as little-endian 32-bit numbers.
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")


def op7_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle sets of Jaccard 0.85 or more."""
    return inverted.near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without runs of three lines, or fewer lines of 50 words, that start earlier elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, words=lines.LONG)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose parts belong together most."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that also start in an earlier document."""
    kept = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    spans = F.size("removed").cast("bigint").alias("n_spans")
    return kept.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after ten rounds around 8 centroids."""
    found = centroids.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_fingerprints": op2_fingerprints,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_mixing": op4_mixing,
    "op5_urls": op5_urls,
    "op6_packing": op6_packing,
    "op7_near_groups": op7_near_groups,
    "op8_language": op8_language,
    "op9_substrings": op9_substrings,
    "op10_lines": op10_lines,
    "op11_phrases": op11_phrases,
    "op12_suffixes": op12_suffixes,
    "op13_centroids": op13_centroids,
}

WORD = r"[^\x20\x09-\x0D]+"


def case(level: str) -> str:
    """Weight of a node in SQL."""
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CASE {level} {whens} ELSE 1 END"


def fill(level: str, parent: str, names: str) -> str:
    """The shares of one level of the tree, in the same whole numbers."""
    by = f"PARTITION BY {parent}" if parent else ""
    match = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in parent.split(", ")) if parent else "true"
    above = {"domain": "root", "lang": "b_domain", "source": "b_lang"}[level]
    own = ", ".join(f"n.{c}" for c in names.split(", "))
    return f"""
      n_{level} AS (
        SELECT {own}, n.capacity, n.weight, p.budget
        FROM (SELECT {names}, sum(capacity)::hugeint AS capacity, ({case(level)})::hugeint AS weight FROM leaves GROUP BY {names}) n
        JOIN {above} p ON {match}),
      f_{level} AS (
        SELECT *, capacity * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_
        FROM n_{level} WINDOW w AS ({by} ORDER BY capacity::double / weight::double, {level} NULLS FIRST)),
      b_{level} AS (
        SELECT {names}, CASE WHEN full_ THEN capacity ELSE least(capacity,
            ((budget - coalesce(sum(capacity) FILTER (full_) OVER ({by}), 0)) * weight
              // coalesce(sum(weight) FILTER (NOT full_) OVER ({by}), 1))::hugeint) END AS budget
        FROM f_{level})"""


MIXING_SQL = f"""
    WITH docs AS (
      SELECT doc_id, lang, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint AS n_tokens,
        CASE WHEN regexp_matches(source, '[0-9]+$') THEN 'd' || (regexp_extract(source, '([0-9]+)$', 1)::bigint % 3)::varchar END AS domain
      FROM documents),
      leaves AS (SELECT domain, lang, source, sum(n_tokens)::hugeint AS tokens, (sum(n_tokens) * 4)::hugeint AS capacity FROM docs GROUP BY ALL),
      root AS (SELECT least(sum(capacity), sum(tokens) * 6 // 10)::hugeint AS budget FROM leaves),
      {fill("domain", "", "domain")},
      {fill("lang", "domain", "domain, lang")},
      {fill("source", "domain, lang", "domain, lang, source")},
      plan AS (
        SELECT b.*, l.tokens, CASE WHEN l.tokens = 0 THEN 0 ELSE b.budget // l.tokens END::bigint AS epochs
        FROM b_source b JOIN leaves l ON b.domain IS NOT DISTINCT FROM l.domain AND b.lang IS NOT DISTINCT FROM l.lang
          AND b.source IS NOT DISTINCT FROM l.source),
      keyed AS (
        SELECT d.*, p.budget, p.tokens, p.epochs, md5('1:' || p.epochs || ':' || coalesce(d.doc_id::varchar, '')) AS key
        FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang
          AND d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN epochs * tokens < budget AND
        sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) <= budget - epochs * tokens
      THEN 1 ELSE 0 END)::bigint AS uses
    FROM keyed"""

LINES_SQL = f"""
    WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
      numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM split),
      counted AS (
        SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, len(regexp_extract_all(line, '{WORD}')) AS size
        FROM numbered WHERE regexp_matches(line, '{WORD}')),
      next_ AS (
        SELECT doc_id, n, line, size, lead(line) OVER w AS second, lead(size) OVER w AS more, lead(line, 2) OVER w AS third
        FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
      runs AS (
        SELECT doc_id, n, 3 AS many, line || chr(10) || second || chr(10) || third AS run FROM next_
        UNION ALL SELECT doc_id, n, 1, line FROM next_ WHERE size >= {lines.LONG}
        UNION ALL SELECT doc_id, n, 2, line || chr(10) || second FROM next_ WHERE size < {lines.LONG} AND size + more >= {lines.LONG}),
      ranked AS (
        SELECT doc_id, n, many, row_number() OVER (PARTITION BY many, run ORDER BY doc_id, n) AS k FROM runs WHERE run IS NOT NULL),
      gone AS (SELECT DISTINCT doc_id, n + j AS n FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 AND j < many),
      drops AS (SELECT c.doc_id, c.i FROM counted c JOIN gone USING (doc_id, n)),
      kept AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered ANTI JOIN drops USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(c.n, 0)::bigint AS n_lines, coalesce(g.n, 0)::bigint AS n_removed,
      CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM counted GROUP BY 1) c USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM drops GROUP BY 1) g USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def value(tag: str, name: str) -> str:
    """Value of an attribute of a tag in SQL."""
    pattern = rf"""(?i)[\s"'']{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))"""
    raw = "(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {i})" for i in (1, 2, 3)) + ")"
    code = """coalesce(try_cast(regexp_extract(m, '^&#0*([0-9]{1,3});$', 1) AS int), try_cast('0x' || regexp_extract(m, '^&#[xX]0*([0-9a-fA-F]{1,2});$', 1) AS int))"""
    letter = f"CASE WHEN {code} = 38 THEN '&amp;' WHEN {code} BETWEEN 1 AND 127 THEN chr({code}) ELSE m END"
    out = f"list_reduce(regexp_extract_all({raw}, '{urls.NUMBERED}'), lambda s, m: replace(s, m, {letter}), {raw})"
    for mark, plain in urls.NAMED:
        out = f"replace({out}, '{mark}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return out


#: A path without dot segments.
TIDY = """CASE WHEN regexp_matches({0}, '/\\.\\.?(/|$)') THEN list_reduce(string_split({0}, '/')[2:], lambda s, x: CASE x WHEN '.' THEN s
    WHEN '..' THEN regexp_replace(s, '/[^/]*$', '') ELSE s || '/' || x END, '') || CASE WHEN regexp_matches({0}, '/\\.\\.?$') THEN '/' ELSE '' END
    ELSE {0} END"""


HOST, PATH = "lower(regexp_extract({0}, '^[^/?#]*'))", "regexp_extract({0}, '^[^/?#]*([^?#]*)', 1)"
KEY = "lower(regexp_extract({0}, '^[^/?#]*')) || regexp_extract({0}, '^[^/?#]*([^#]*)', 1)"
REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) END"
RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

URLS_SQL = rf"""
    WITH RECURSIVE rules(verdict, host, path) AS (VALUES {RULE_ROWS}),
      pages_ AS (
        SELECT page_id, url, html, {REST.format("url")} AS rest FROM pages),
      p AS (
        SELECT page_id, url, html, coalesce({HOST.format("rest")}, '') AS host, coalesce({PATH.format("rest")}, '') AS path, {KEY.format("rest")} AS key
        FROM pages_),
      tags AS (SELECT key, url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE key IS NOT NULL),
      aims AS (
        SELECT key, url, host, path, trim(CASE
          WHEN list_contains(regexp_split_to_array(lower(trim({value("tag", "rel")})), '\s+'), 'canonical') THEN {value("tag", "href")}
          WHEN lower(trim({value("tag", "http-equiv")})) = 'refresh'
            THEN regexp_extract({value("tag", "content")}, '(?i);\s*url\s*=\s*[''"]?([^''"]*)', 1) END) AS aim
        FROM tags),
      whole AS (
        SELECT key, CASE WHEN regexp_matches(aim, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN aim
            WHEN starts_with(aim, '//') THEN 'http:' || aim WHEN starts_with(aim, '/') THEN 'http://' || host || aim
            WHEN starts_with(aim, '?') THEN 'http://' || host || path || aim WHEN starts_with(aim, '#') THEN url
            ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)?') = '' THEN '/' ELSE regexp_extract(path, '^(.*/)?') END || aim END AS target
        FROM aims WHERE aim <> ''),
      aimed AS (SELECT key, {REST.format("target")} AS rest FROM whole),
      parted AS (SELECT key, rest, {PATH.format("rest")} AS path, regexp_extract(rest, '^[^?#]*(.*)$', 1) AS more FROM aimed WHERE rest IS NOT NULL),
      far AS (SELECT key, {HOST.format("rest")} || {TIDY.format("path")} || more AS rest FROM parted),
      links AS (SELECT key, {KEY.format("rest")} AS other, {HOST.format("rest")} AS host, {PATH.format("rest")} AS path FROM far WHERE rest IS NOT NULL),
      both_ AS (SELECT key AS a, other AS b FROM links WHERE key <> other UNION SELECT other, key FROM links WHERE key <> other),
      reach(node, seen) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT r.node, b FROM reach r JOIN both_ ON r.seen = a),
      groups_ AS (SELECT node AS key, min(seen) AS component FROM reach GROUP BY node),
      nodes AS (SELECT key, host, path FROM p WHERE key IS NOT NULL UNION SELECT other, host, path FROM links),
      fits AS (
        SELECT n.key, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY n.key ORDER BY length(r.host || r.path) DESC, r.host || r.path, r.verdict DESC) AS k
        FROM nodes n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)),
      ruled AS (SELECT key, rule, verdict FROM fits WHERE k = 1),
      spoken AS (
        SELECT component, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS bad FROM groups_ JOIN ruled USING (key) GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(component, key) AS alias
    FROM p LEFT JOIN ruled USING (key) LEFT JOIN groups_ USING (key) LEFT JOIN spoken USING (component)"""

def closure(links: str) -> str:
    """Smallest node reachable along the links (a, b), given in both directions."""
    return f"""
      reach(node, seen) AS (SELECT DISTINCT a, a FROM {links} UNION SELECT r.node, l.b FROM reach r JOIN {links} l ON r.seen = l.a),
      components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


LATTICE_SQL = f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::double[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98),
      {closure("links")}
    SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN components ON node = vec_id"""

NEAR_SQL = f"""
    WITH RECURSIVE split AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{WORD}'), []) AS ws FROM documents),
      sets AS (
        SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END, ' ')) AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM split WHERE len(ws) > 0)),
      sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
      both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
      pairs AS (
        SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_.n >= 85 * (x.n + y.n - both_.n)),
      links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
      {closure("links")}
    SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
    FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN components ON node = doc_id"""

SUBSTRINGS_SQL = f"""
    WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM documents),
      windows AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS run
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM split WHERE len(ws) >= 20)),
      late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
      gone AS (SELECT doc_id, list(DISTINCT i + j) AS places FROM late, range(20) r(j) GROUP BY doc_id),
      kept AS (
        SELECT doc_id, len(ws) AS n, coalesce(len(places), 0) AS n_removed,
          CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(places, i)) END AS ws
        FROM split LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n::bigint AS n_words, n_removed::bigint AS n_removed, sha256(array_to_string(ws, ' ')) AS kept_sha256 FROM kept"""

PHRASES_SQL = f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
      split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
      sizes AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY lang),
      places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
      f AS MATERIALIZED (
        SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
        FROM places, range(1, 6) lengths(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING a >= 100),
      kept AS (
        SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
          SELECT 1 FROM f g WHERE g.lang = f.lang AND g.k > f.k AND g.a >= f.a AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
      cuts AS (
        SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, n, (1000 * c.a::hugeint * n) // (h.a::hugeint * t.a) AS score, h.k AS cut
        FROM kept c JOIN f h ON h.lang = c.lang AND h.k < c.k AND starts_with(c.phrase, h.phrase || ' ')
          JOIN f t ON t.lang = c.lang AND t.phrase = c.phrase[length(h.phrase) + 2:] JOIN sizes s ON s.lang = c.lang),
      scored AS (
        SELECT lang, phrase, a, n, min(score) AS score, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r FROM cuts GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
    SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked WHERE rank <= 2000"""


#: Bytes as two hexadecimal digits each, cut into blocks first: a place in a long string is found by walking to it.
SUFFIXES_SQL = """
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      blocks AS (SELECT rid, doc_id, b, substr(h, 1 + 2 * b, 1122) AS part FROM (SELECT *, unnest(range(0, length(h) // 2, 512)) AS b FROM texts)),
      windows AS (
        SELECT rid, doc_id, b + j AS p, substr(part, 1 + 2 * j, 100) AS w
        FROM (SELECT *, unnest(range(0, least(512, length(part) // 2 - 49))) AS j FROM blocks)),
      least_ AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
      late AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS back FROM windows JOIN least_ USING (w) WHERE first < doc_id),
      runs AS (SELECT rid, p, sum((back IS NULL OR p > back + 50)::int) OVER (PARTITION BY rid ORDER BY p) AS run FROM late),
      spans AS (SELECT rid, run, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY ALL),
      keeps AS (SELECT rid, run, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY run), 0) AS a, a AS z FROM spans),
      tails AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z FROM spans GROUP BY rid),
      heads AS (SELECT rid, string_agg(substr(h, 1 + 2 * a, 2 * (z - a)), '' ORDER BY run) AS h FROM keeps JOIN texts USING (rid) GROUP BY rid)
    SELECT doc_id, length(t.h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
      sha256(unhex(coalesce(heads.h || substr(t.h, 1 + 2 * z), t.h))) AS kept_sha256
    FROM texts t LEFT JOIN tails USING (rid) LEFT JOIN heads USING (rid)"""


def centroids_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Each round as a table of squared distances, the nearest centroid, and the new centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
      asg{r} AS MATERIALIZED (
        SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
        FROM (SELECT rid, cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (dim) GROUP BY rid, cluster) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
      c{r + 1} AS MATERIALIZED (
        SELECT cluster, dim, coalesce((s - ((s % n) + n) % n) // n, v) AS v
        FROM c{r} LEFT JOIN (SELECT cluster, dim, sum(v) AS s, count(*)::hugeint AS n FROM x JOIN asg{r} USING (rid) GROUP BY ALL) USING (cluster, dim))""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
      x AS MATERIALIZED (
        SELECT rid, dim, floor(1024 * embedding[dim]::double)::hugeint AS v
        FROM (SELECT rid, embedding, unnest(range(1, {width + 1})) AS dim FROM kept)),
      c0 AS MATERIALIZED (
        SELECT cluster, dim, v FROM x JOIN (
          SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {k}) USING (rid)),{",".join(steps)},
      sums AS (
        SELECT cluster, sum(d)::bigint AS cluster_inertia, sum(sum(d)) OVER ()::bigint AS inertia FROM asg{rounds} GROUP BY cluster),
      names AS (SELECT cluster, sha256(string_agg(v::varchar, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT vec_id, cluster::int AS cluster, d::bigint AS distance, cluster_inertia, inertia, centroid_sha256
    FROM kept JOIN asg{rounds} USING (rid) JOIN sums USING (cluster) JOIN names USING (cluster)"""


CENTROIDS_SQL = centroids_sql()

SQL: dict[str, str] = {
    "op1_lattice": LATTICE_SQL,
    "op4_mixing": MIXING_SQL,
    "op5_urls": URLS_SQL,
    "op7_near_groups": NEAR_SQL,
    "op9_substrings": SUBSTRINGS_SQL,
    "op10_lines": LINES_SQL,
    "op11_phrases": PHRASES_SQL,
    "op12_suffixes": SUFFIXES_SQL,
    "op13_centroids": CENTROIDS_SQL,
}
