"""What SQL can say of the corpus queries, written for DuckDB and independent of the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def contamination(width: int = 10) -> str:
    words = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce({words.format(text=lowered("text"))}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words.format(text=lowered("text"))} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {width}) AS size,
    array_to_string(w[spot : spot + least(len(w), {width}) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) t(spot) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT doc_id, spot, size, array_to_string(w[spot : spot + size - 1], ' ') AS phrase
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) t(spot)),
met AS (SELECT s.doc_id, s.spot, s.size, w.item_id FROM spots s JOIN windows w USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM met, unnest(range(spot, spot + size)) t(place) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)"""


def ngram_links(width: int = 3, numerator: int = 90, denominator: int = 100) -> str:
    joined = " || ' ' || ".join(f"w[i + {n}]" for n in range(width))
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {joined})) END AS s FROM docs),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
    AND {denominator} * least(a.n, b.n) >= {numerator} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE {denominator} * common >= {numerator} * (na + nb - common)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, p.b FROM reached r JOIN pairs p ON p.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)"""


def manifest(source_levels: int = 5, top_levels: int = 4, fanout: int = 16) -> str:
    """Trees of at most ``fanout ** source_levels`` rows a source and ``fanout ** top_levels`` sources."""
    fields = ("doc_id", "source", "lang", "n_chars")
    one = "coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    head = " || ".join(one.format(v=f) for f in fields)
    crc = """list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
      lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS BIGINT) + 1]))"""

    def tree(name: str, key: str, levels: int) -> str:
        """CTEs <name>1 .. of nodes and <name>_run0 .. of the joined digests of each run, from <name>0(key, i, n, d)."""
        parts = []
        for level in range(levels):
            parts.append(f"""{name}_run{level} AS (SELECT {key}, i // {fanout} AS run, n, string_agg(d, '' ORDER BY i) AS joined
  FROM {name}{level} GROUP BY ALL),
{name}{level + 1} AS (SELECT {key}, run AS i, CASE WHEN n > 1 THEN (n + {fanout - 1}) // {fanout} ELSE 1 END AS n,
    CASE WHEN n > 1 THEN sha256(joined) ELSE joined END AS d FROM {name}_run{level})""")
        return ",\n".join(parts)

    def walk(name: str, key: str, at: str, levels: int, begin: str) -> tuple[str, str]:
        """CTEs that fold every row up one tree, from ``begin``: node, proof."""
        parts, last = [], begin
        for level in range(levels):
            scale = fanout**level
            place = f"({at} // {scale}) % {fanout}"
            parts.append(f"""{name}_up{level} AS (SELECT w.* EXCLUDE (node, proof),
    CASE WHEN r.n > 1 THEN sha256(substr(joined, 1, 64 * ({place})) || node || substr(joined, 64 * ({place}) + 65)) ELSE node END AS node,
    CASE WHEN r.n > 1 THEN proof || substr(joined, 1, 64 * ({place})) || substr(joined, 64 * ({place}) + 65) ELSE proof END AS proof
  FROM {last} w JOIN {name}_run{level} r ON r.{key} IS NOT DISTINCT FROM w.{key} AND r.run = {at} // {scale * fanout})""")
            last = f"{name}_up{level}"
        return ",\n".join(parts), last

    up, folded = walk("s", "source", "nth", source_levels, "begun")
    top_up, done = walk("t", "every", "place", top_levels, "topped")
    return f"""
WITH crc_table AS (SELECT list(list_reduce([i::UBIGINT] || range(8)::UBIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) t(i)),
leaves AS (SELECT doc_id, source, sha256({head} || {one.format(v="text")}) AS leaf,
    sha256({head} || {one.format(v=lowered("text"))}) AS changed,
    coalesce(xor({crc}, 4294967295::UBIGINT) % 5 = 0, false) AS tampered FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
s0 AS (SELECT source, nth AS i, n, leaf AS d FROM placed),
{tree("s", "source", source_levels)},
tops AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
    count(*) OVER () AS n FROM s{source_levels}),
t0 AS (SELECT 1 AS every, place AS i, n, subroot AS d FROM tops),
{tree("t", "every", top_levels)},
begun AS (SELECT doc_id, source, leaf, nth, CASE WHEN tampered THEN changed ELSE leaf END AS node, '' AS proof FROM placed),
{up},
topped AS (SELECT w.*, subroot, place, 1 AS every FROM {folded} w JOIN tops o ON o.source IS NOT DISTINCT FROM w.source),
{top_up}
SELECT doc_id, leaf, subroot, (SELECT d FROM t{top_levels}) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = (SELECT d FROM t{top_levels}) AS verified FROM {done}"""
