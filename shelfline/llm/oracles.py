"""DuckDB SQL of the queries here that SQL can express."""

from __future__ import annotations

from shelfline.llm import licenses, secret_ledger

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licenses() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = sorted(licenses.PHRASES.items(), key=lambda p: p[1])

    def places(phrase: str) -> str:
        here = " AND ".join(f"w[i + {n}] = {_text(word)}" for n, word in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i: {here})"

    found = ", ".join(f"{places(phrase)} AS p{n}" for n, (phrase, _) in enumerate(phrases))
    every = " || ".join(f"p{n}" for n in range(len(phrases)))
    named = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN {_text(label)} END" for n, (_, label) in enumerate(phrases))
    lengths = licenses.template_lengths(licenses.TEMPLATES)
    templates = ", ".join(
        f"({_text(label)}, {lengths[label]}, [{', '.join(map(_text, sorted(words)))}])" for label, words in licenses.template_words(licenses.TEMPLATES).items()
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS t FROM documents),
    worded AS (SELECT *, regexp_extract_all(t, '{word}') AS w FROM d),
    placed AS (SELECT r, doc_id, w, {found} FROM worded),
    based AS (SELECT r, doc_id, w, {every} AS p, list_filter([{named}], lambda x: x IS NOT NULL) AS base FROM placed),
    templates(label, m, tw) AS (VALUES {templates}),
    starts AS (SELECT r, w, label, m, tw, unnest(range(0, len(w), m)) AS i FROM worded, templates),
    blocks AS (SELECT r, label, tw, list_distinct(list_slice(w, i + 1, i + 2 * m)) AS bw FROM starts),
    hits AS (SELECT r, label, len(list_intersect(bw, tw)) / len(tw) AS share FROM blocks
             WHERE len(list_intersect(bw, tw)) >= {licenses.CONTAINMENT} * len(tw) - 1e-9),
    best AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hits GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
           array_to_string(base, ',') AS base_labels,
           array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
           CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
    FROM based LEFT JOIN best USING (r)"""


_SUBSTRINGS = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
    windows AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS window_words FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    firsts AS (SELECT window_words, min(doc_id) AS f FROM windows GROUP BY window_words),
    covered AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (window_words) WHERE f < doc_id),
    words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS k FROM words ANTI JOIN covered ON words.r = covered.r AND words.p = covered.p GROUP BY words.r),
    gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)"""

_PARTENUM = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
    grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(a, b) AS (SELECT a, b FROM ways UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
    least_of AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least_of ON doc_id = a"""


def _secrets() -> str:
    def spans(n: int, rule: secret_ledger.Rule) -> str:
        around = _text(f"(?s)(.*?)({rule.pattern})")
        gap, match, part = (f"regexp_extract_all(t, {around}, {group})" for group in (1, 2, 2 + rule.part))
        before = "coalesce(list_sum(list_transform(x.g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(x.m[1:i - 1], lambda y: length(y))), 0)"
        every = f"list_transform(range(1, len(x.m) + 1), lambda i: {{s: ({before})::BIGINT, k: {n}, e: ({before} + length(x.m[i]))::BIGINT, l: length(x.v[i])}})"
        return f"(SELECT list_filter({every}, lambda z: z.l >= {rule.least}) FROM (SELECT {{g: {gap}, m: {match}, v: {part}}} AS x)) AS k{n}"

    rules = secret_ledger.RULES
    columns = ", ".join(spans(n, rule) for n, rule in enumerate(rules))
    kinds = "[" + ", ".join(_text(rule.kind) for rule in rules) + "]"

    def joined(numbers) -> str:
        every = " || ".join(f"k{n}" for n in numbers)
        return f"array_to_string(list_transform(list_sort({every}), lambda z: {kinds}[z.k + 1] || ':' || z.s || ':' || z.e), ',')"

    base = ", ".join(f"len(k{n})::BIGINT AS n_{rules[n].kind}" for n in range(secret_ledger.BASE))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (SELECT doc_id, {columns} FROM d)
    SELECT doc_id, {base}, sha256({joined(range(secret_ledger.BASE))}) AS base_sha256, {joined(range(len(rules)))} AS spans FROM found"""


#: Levels that the SQL of the manifest has: enough for 16 ** 5 rows a source and as many sources.
_LEVELS = 5


def _crc(text: str) -> str:
    """crc32 of a text of decimal digits."""
    bits = "list_reduce(list_prepend({start}, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    step = bits.format(start="xor(a, b)")
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)), lambda a, b: {step}), 4294967295)"


def _manifest() -> str:
    def framed(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, group: str, first: str) -> str:
        """Nodes {name}0, {name}1, ... (group, k, n, digest) up to one node, and the siblings of each."""
        out = [f"{name}0 AS ({first})"]
        for level in range(_LEVELS):
            out.append(
                f"{name}{level + 1} AS (SELECT {group}, k // 16 AS k, (n + 15) // 16 AS n, "
                f"CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY k)) ELSE min(digest) END AS digest FROM {name}{level} GROUP BY {group}, k // 16, n)"
            )
        for level in range(_LEVELS):
            frame = f"OVER (PARTITION BY {group}, k // 16 ORDER BY k ROWS BETWEEN"
            out.append(
                f"{name}s{level} AS (SELECT {group}, k, n, coalesce(string_agg(digest, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(digest, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{level})"
            )
        return ", ".join(out)

    def climbed(name: str, source: str, place: str, group: str) -> list[str]:
        out, below = [], source
        for level in range(_LEVELS):
            step = f"{name}c{level}"
            out.append(
                f"{step} AS (SELECT b.* EXCLUDE (proof, folded), b.proof || s.l || s.r AS proof, "
                f"CASE WHEN s.n > 1 THEN sha256(s.l || b.folded || s.r) ELSE b.folded END AS folded "
                f"FROM {below} b JOIN {name}s{level} s ON {group} AND s.k = b.{place} // {16**level})"
            )
            below = step
        return out

    low = f"CASE WHEN {_crc('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    leaves = f"""leaves AS (SELECT doc_id, source, {leaf('text')} AS digest, {leaf('(' + low + ')')} AS given FROM documents),
    ranked AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM leaves)"""
    groups = f"SELECT 0 AS t, g, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n, digest FROM a{_LEVELS}"
    lower = climbed("a", "begun", "k", "s.g = b.g")
    begun = "begun AS (SELECT doc_id, digest AS leaf, g, k, '' AS proof, given AS folded FROM ranked)"
    met = f"met AS (SELECT c.doc_id, c.leaf, c.proof, c.folded, p.digest AS subroot, p.k AS place FROM ac{_LEVELS - 1} c JOIN places p ON p.g = c.g)"
    upper = climbed("b", "met", "place", "true")
    parts = [leaves, tree("a", "g", "SELECT g, k, n, digest FROM ranked"), begun, *lower, f"places AS ({groups})"]
    parts += [tree("b", "t", "SELECT t, k, n, digest FROM places"), met, *upper]
    return f"""WITH {", ".join(parts)}
    SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
    FROM bc{_LEVELS - 1} JOIN b{_LEVELS} ON true"""


ORACLES: dict[str, str] = {
    "op3_licenses": _licenses(),
    "op4_substrings": _SUBSTRINGS,
    "op7_partenum": _PARTENUM,
    "op10_secret_ledger": _secrets(),
    "op12_merkle_manifest": _manifest(),
}
