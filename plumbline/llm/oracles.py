"""Reference SQL (another engine's dialect) of the operators that SQL can express."""

from __future__ import annotations

from plumbline.llm.quality_rules import COMMON_WORDS, WINDOW, Limits
from plumbline.llm.sharding import Leaf, tree
from plumbline.llm.substring_dedup import LENGTH

WORDS = r"'[^\x20\x09-\x0D]+'"
SEPARATORS = r"'[\x20\x09-\x0D]+'"


def unit(*parts: str) -> str:
    """The 60-bit hash of parts."""
    return f"cast(concat('0x', substring(md5(concat_ws(':', {', '.join(parts)})), 1, 15)) AS bigint)"


def mixing(entropy: float = 0.95, repeats: float = 4.0, block: int = 1 << 16) -> str:
    key = "cast(doc_id AS varchar)"
    return f"""WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, source, cast(floor((strlen(coalesce(text, '')) + 3) / 4) AS bigint) AS tokens FROM documents WHERE strlen(coalesce(text, '')) > 0),
sources AS MATERIALIZED (SELECT source, sum(tokens)::bigint AS tokens FROM sized GROUP BY source),
total AS MATERIALIZED (SELECT sum(tokens)::bigint AS total, count(*) AS n FROM sources),
logs AS MATERIALIZED (SELECT ln(tokens / cast(total AS double)) AS l, total, n FROM sources, total),
by_entropy AS (SELECT 0 AS step, cast(0 AS double) AS low, cast(1 AS double) AS high UNION ALL
    SELECT step + 1, CASE WHEN good THEN m ELSE low END, CASE WHEN good THEN high ELSE m END FROM (SELECT step, low, high, m,
        (SELECT ln(sum(exp(m * l))) - m * sum(exp(m * l) * l) / sum(exp(m * l)) >= {entropy} * ln(max(n)) FROM logs) AS good FROM (SELECT *, (low + high) / 2 AS m FROM by_entropy WHERE step < 52))),
first_alpha AS MATERIALIZED (SELECT CASE WHEN (SELECT max(n) FROM logs) = 1 OR (SELECT ln(sum(exp(l))) - sum(exp(l) * l) / sum(exp(l)) >= {entropy} * ln(max(n)) FROM logs) THEN cast(1 AS double) ELSE (SELECT low FROM by_entropy WHERE step = 52) END AS a0),
over AS MATERIALIZED (SELECT a0, (SELECT exp(max((a0 - 1.0) * l)) / sum(exp(a0 * l)) FROM logs) AS r0, (SELECT 1.0 / sum(exp(l)) FROM logs) AS r1 FROM first_alpha),
by_repeats AS (SELECT 0 AS step, cast(0 AS double) AS low, cast(1 AS double) AS high UNION ALL
    SELECT step + 1, CASE WHEN good THEN m ELSE low END, CASE WHEN good THEN high ELSE m END FROM (SELECT step, low, high, m,
        ((SELECT exp(max((m - 1.0) * l)) / sum(exp(m * l)) FROM logs) > {repeats} OR m <= (SELECT a0 FROM over)) AS good FROM (SELECT *, (low + high) / 2 AS m FROM by_repeats WHERE step < 52))),
alpha AS MATERIALIZED (SELECT CASE WHEN r0 <= {repeats} THEN a0 WHEN r1 > {repeats} THEN cast(1 AS double) ELSE (SELECT high FROM by_repeats WHERE step = 52) END AS a FROM over),
powers AS MATERIALIZED (SELECT source, tokens, total, exp(a * ln(tokens / cast(total AS double))) AS p FROM sources, total, alpha),
plan AS MATERIALIZED (SELECT source, tokens AS own, budget, cast(ceil(tokens / {block}.0) AS bigint) AS blocks, budget // tokens AS epochs, budget % tokens AS rest
    FROM (SELECT *, cast(floor(p / (SELECT sum(p) FROM powers) * total) AS bigint) AS budget FROM powers)),
placed AS MATERIALIZED (SELECT s.*, own, epochs, rest, {unit(key, "'block'", "'0'")} % blocks AS block FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source),
runs AS MATERIALIZED (SELECT source, block, epochs, rest, own, unnest(range(0, epochs + 1)) AS epoch, size FROM (SELECT source, block, any_value(epochs) AS epochs, any_value(rest) AS rest, any_value(own) AS own, sum(tokens) AS size FROM placed GROUP BY source, block)),
turned AS MATERIALIZED (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, epoch ORDER BY {unit("coalesce(source, 'null')", 'cast(block AS varchar)', 'cast(epoch AS varchar)', "'0'")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs),
drawn AS MATERIALIZED (SELECT p.doc_id, p.source, p.tokens, t.epoch, p.block, t.epoch * p.own AS done, CASE WHEN t.epoch < p.epochs THEN p.own ELSE p.rest END AS most,
    before + coalesce(sum(p.tokens) OVER (PARTITION BY p.source, p.block, t.epoch ORDER BY {unit('cast(p.doc_id AS varchar)', 'cast(t.epoch AS varchar)', "'0'")}, p.doc_id, p.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM placed p JOIN turned t ON t.source IS NOT DISTINCT FROM p.source AND t.block = p.block)
SELECT doc_id, source, tokens, epoch, block, cast(done + place AS bigint) AS start FROM drawn WHERE place < most"""


def _winner(level: str, children: dict[str, float], path: str) -> str:
    """SQL of the child with the smallest draw."""
    draws = ", ".join(f"{{'d': -ln(({unit('key', path, repr(name))} + 1) / 1152921504606846976.0::double) / {weight!r}, 'n': {name!r}}}" for name, weight in children.items())
    return f"list_min([{draws}])['n']"


def _descend(leaves: list[Leaf]) -> str:
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in leaves:
        names = ["", leaf.region, f"{leaf.region}/{leaf.rack}", str(leaf.shard)]
        for i in range(3):
            own = levels[i].setdefault(names[i], {})
            own[names[i + 1]] = own.get(names[i + 1], 0.0) + leaf.weight
    top = _winner("", levels[0][""], "''")
    by = lambda column, level: "CASE " + column + " " + " ".join(f"WHEN {p!r} THEN {_winner('', c, repr(p))}" for p, c in level.items()) + " END"
    return f"SELECT doc_id, cast({by('rack', levels[2])} AS int) AS shard FROM (SELECT *, {by('region', levels[1])} AS rack FROM (SELECT *, {top} AS region FROM keyed))"


def sharding(shards: int = 40, parts: int = 256) -> str:
    """Checksums are folded over the bytes, one table step a byte."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"""WITH keyed AS MATERIALIZED (SELECT doc_id, cast(doc_id AS varchar) AS key FROM documents),
sized AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast(concat('0x', h) AS bigint))), lambda c, b: {step}), 4294967295) AS text_crc32 FROM documents),
placed AS MATERIALIZED (SELECT z.*, a.shard, g.shard AS grown_shard, {unit('k.key', 'cast(z.size AS varchar)', 'cast(z.text_crc32 AS varchar)')} % {parts} AS part FROM sized z JOIN keyed k ON k.doc_id = z.doc_id JOIN ({_descend(tree(shards))}) a ON a.doc_id = z.doc_id JOIN ({_descend(tree(shards + 1))}) g ON g.doc_id = z.doc_id)
SELECT doc_id, cast(size AS bigint) AS size, cast(text_crc32 AS bigint) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""


def substring_dedup() -> str:
    n = LENGTH
    return f"""WITH split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM split WHERE len(ws) >= {n})),
least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM windows JOIN least USING (w) WHERE doc_id > first),
each AS (SELECT s.doc_id, w, p, g.p IS NOT NULL AS cut FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM split) s LEFT JOIN gone g USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (NOT cut), '') AS rest FROM each GROUP BY doc_id)
SELECT s.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""


def near_dedup(n: int = 4, percent: int = 80) -> str:
    return f"""WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
each AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) AS i FROM split WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT DISTINCT a AS id, a AS far FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.far),
comps AS MATERIALIZED (SELECT id, min(far) AS c FROM reach GROUP BY id)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id LEFT JOIN comps ON id = s.doc_id"""


def quality_rules(limits: Limits = Limits()) -> str:  # noqa: B008
    w = WINDOW
    size = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    classes = ["[a-z]", r"[^\x00-\x7F]", "[A-Z]", "[0-9]", r"[!-/:-@\[-`{-~\x00-\x08\x0E-\x1F\x7F]", r"[\x20\x09-\x0D]"]
    listed = lambda words: "[" + ", ".join(f"len(list_filter(ws, lambda y: lower(y) = '{c}'))" for c in words) + ", len(list_filter(ws, lambda y: lower(y) NOT IN (" + ", ".join(f"'{c}'" for c in words) + ")))]"
    commons = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {listed(words)}" for lang, words in COMMON_WORDS.items()) + " END"
    k = len(classes), len(next(iter(COMMON_WORDS.values()))) + 1

    def distance(p: str, q: str) -> str:
        term = "CASE WHEN z.a > 0 THEN z.a * log2(2 * z.a / (z.a + z.b)) / 2 ELSE 0 END + CASE WHEN z.b > 0 THEN z.b * log2(2 * z.b / (z.a + z.b)) / 2 ELSE 0 END"
        pair = f"list_transform(range(1, len({p}) + 1), lambda i: {{'a': {p}[i] / list_sum({p})::double, 'b': {q}[i] / list_sum({q})::double}})"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform({pair}, lambda z: {term})))) END"

    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i + 1}]), 0)" for i in range(n)) + "]"
    return f"""WITH split AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {w - 1}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM split WHERE len(ws) >= {w})),
twice AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {w}) AS gap FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least(gap, {w}))::bigint AS n FROM twice GROUP BY doc_id),
measured AS MATERIALIZED (SELECT s.*, len(ws)::bigint AS n_words, length(regexp_replace(t, {SEPARATORS}, '', 'g'))::bigint AS word_chars, ({size('[#*$%&|<>]')})::bigint AS n_symbols, coalesce(r.n, 0) AS n_repeat_words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {WORDS})) AS lines, [{', '.join(size(c) for c in classes)}] AS classes, {commons} AS commons FROM split s LEFT JOIN repeated r ON r.doc_id = s.doc_id),
refs AS MATERIALIZED (SELECT lang, {sums('classes', k[0])} AS rc, {sums('commons', k[1])} AS rw FROM measured WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0) GROUP BY lang),
judged AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN word_chars >= {limits.min_chars} THEN {distance('classes', 'rc')} END AS dc, CASE WHEN n_words >= {limits.min_words} THEN {distance('commons', 'rw')} END AS dw
    FROM measured m LEFT JOIN refs r ON r.lang IS NOT DISTINCT FROM m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(dc, 0) > {limits.classes} OR coalesce(dw, 0) > {limits.words}) AS kept FROM judged"""


ORACLES = {
    "op2_mixing": mixing(),
    "op5_sharding": sharding(),
    "op6_substring_dedup": substring_dedup(),
    "op7_near_dedup": near_dedup(),
    "op9_quality_rules": quality_rules(),
}
