"""SQL that says the same as the queries, for another engine on the same tables."""

from __future__ import annotations

from collections.abc import Iterable

from tessel.functions.text import SPACE, WORD, word_pattern
from tessel.functions.text import stem_of
from tessel.plans import lexicon as lx
from tessel.plans.lexicon import DEFAULT
from tessel.queries import CLASSES, LABELS, QUERY_TEXTS, RULE


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(xs: Iterable[str]) -> str:
    return "([" + ", ".join(map(quoted, xs)) + "]::VARCHAR[])"


def clean(x: str) -> str:
    tags = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    plain = f"regexp_replace({tags}, {quoted(f'[^{WORD}{SPACE}\\-' + chr(39) + ']')}, ' ', 'g')"
    return f"trim(regexp_replace({plain}, '[{SPACE}]+', ' ', 'g'))"


def words(clean_text: str) -> str:
    return f"list_filter(string_split({clean_text}, ' '), lambda t: length(t) > 1)"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} = 'scarves' THEN 'scarf' "
        f"WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%sses' OR {w} LIKE '%ches' OR {w} LIKE '%shes' OR {w} LIKE '%xes' THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND NOT ({w} LIKE '%ss' OR {w} LIKE '%us' OR {w} LIKE '%is') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def stems(ws: str) -> str:
    return f"list_transform({ws}, lambda w: {stem('w')})"


def ngrams(ws: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({ws}) - {n} + 2, 1)), lambda i: array_to_string({ws}[i : i + {n - 1}], ' '))"


def union(a: str, b: str) -> str:
    """Elements of both in order of their first occurrence."""
    both = f"list_concat({a}, {b})"
    return f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"


def either(a: str, b: str) -> str:
    """The same as a set."""
    return f"list_distinct(list_concat({a}, {b}))"


def has_word(q: str, *terms: str) -> str:
    return f"regexp_matches({q}, {quoted(word_pattern(*terms))})"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


# -- vectors ---------------------------------------------------------------------------------------------------------


def scored(vec_id: int = 0) -> str:
    """CTEs: s has the score of every point."""
    return f"""q AS (SELECT embedding AS query FROM embeddings WHERE vec_id = {vec_id}),
s AS (SELECT vec_id AS point_id, vec_id // 2 AS product_id, vec_id % 2 = 1 AS is_title, {dot('embedding', 'query')} AS score FROM embeddings, q),
both_sides AS (SELECT product_id, max(CASE WHEN NOT is_title THEN score END) AS image, max(CASE WHEN is_title THEN score END) AS title FROM s GROUP BY product_id)"""


def hits(n: int) -> str:
    return f"h AS (SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM s QUALIFY rank <= {n})"


GROUPED = """g AS (
  SELECT product_id, max(CASE WHEN NOT is_title THEN score END) AS image_score, max(CASE WHEN is_title THEN score END) AS title_score,
         min(CASE WHEN NOT is_title THEN rank END) AS image_rank, min(CASE WHEN is_title THEN rank END) AS title_rank, min(rank) AS place
  FROM h GROUP BY product_id)"""


def weighted(image: str, title: str, mode: str, w: tuple[float, float] | None = None) -> str:
    a, b = w or ((0.85, 0.15) if mode == "image" else (0.25, 0.75))
    plain = f"{a} * {image} + {b} * {title}"
    return plain if mode != "image" else f"CASE WHEN {image} >= 0.95 THEN CASE WHEN {title} = 0 THEN {image} ELSE 0.95 * {image} + 0.05 * {title} END ELSE {plain} END"


def unified(mode: str, strategy: str, top_k: int | None = None, w: tuple[float, float] | None = None) -> str:
    pool = max(100, 8 * (top_k or 1))
    score = {
        "rrf": f"1.0::DOUBLE / (60 + coalesce(image_rank, {pool + 1})) + 1.0::DOUBLE / (60 + coalesce(title_rank, {pool + 1}))",
        "score_fusion": "(i + t) / 2",
    }.get(strategy) or weighted("i", "t", mode, w)
    return f"""WITH {scored()}, {hits(pool)}, {GROUPED},
im AS (SELECT product_id, score, row_number() OVER (ORDER BY score DESC, point_id) AS late FROM s WHERE NOT is_title QUALIFY late <= {pool}),
m AS (
  SELECT coalesce(g.product_id, im.product_id) AS product_id, coalesce(greatest(image_score, im.score), image_score, im.score) AS image_score, title_score,
         coalesce(image_rank, late) AS image_rank, title_rank, coalesce(place, 1073741824 + late) AS seq
  FROM g FULL JOIN im ON g.product_id = im.product_id),
f AS (
  SELECT m.*, coalesce(image_score, b.image, 0) AS i, coalesce(title_score, b.title, 0) AS t FROM m LEFT JOIN both_sides b USING (product_id)),
o AS (SELECT *, round({score}, 4) AS final_score FROM f)
SELECT product_id, row_number() OVER (ORDER BY final_score DESC, seq, product_id) AS rank, final_score, round(i, 4) AS image_score, round(t, 4) AS title_score
FROM o {f'QUALIFY rank <= {top_k}' if top_k else ''}"""


def calibrate(x: str) -> str:
    return f"CASE WHEN {x} <= 0.12 THEN greatest(0.0::DOUBLE, {x} * 2) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.24 + ({x} - 0.12::DOUBLE) / 0.22::DOUBLE * 0.71::DOUBLE)) END"


CLIFF = f"""WITH {scored()},
l AS (SELECT label, s.point_id, round(score + 0.2::DOUBLE, 4) AS score FROM s JOIN embeddings e ON e.vec_id = s.point_id),
v AS (
  SELECT *, row_number() OVER w - 1 AS i, lead(score) OVER w AS nxt, first(score) OVER w AS top FROM l WHERE score > 0 AND score >= {RULE.text_floor}
  WINDOW w AS (PARTITION BY label ORDER BY score DESC, point_id)),
e AS (
  SELECT *, score - nxt >= {RULE.gap}::DOUBLE AND i >= 1 AS gap,
         (score - nxt >= {RULE.gap}::DOUBLE AND i >= 1) OR (nxt < greatest({RULE.text_floor}::DOUBLE, top * {RULE.least_ratio}::DOUBLE) AND i >= 2) AS stop FROM v),
x AS (SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY label) AS last FROM e)"""


# -- intent ----------------------------------------------------------------------------------------------------------

QUERIES_TABLE = "queries(query_id, query) AS (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(q)})" for i, q in enumerate(QUERY_TEXTS)) + ")"


def case(pairs: Iterable[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " END"


ASKED = f"""queries(query_id, query) AS (
  SELECT 'c/' || conv_id || '/' || turn, text FROM conversations
  UNION ALL SELECT 'p/' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN t ELSE t || ' ' || p_name END FROM (SELECT *, {listed(QUERY_TEXTS)}[p_partkey % {len(QUERY_TEXTS)} + 1] AS t FROM part))"""


def intent_ctes(source: str = QUERIES_TABLE) -> str:
    category = case((has_word("q", *c.terms), quoted(c.name)) for c in DEFAULT.by_priority())
    gender = case((has_word("q", *ws), quoted(g)) for g, ws in lx.GENDER_WORDS.items())
    colour = case((has_word("q", c), quoted(c)) for c in lx.QUERY_COLOURS)
    about = " OR ".join(f"contains(q, {quoted(x)})" for x in lx.IN_DOMAIN)
    off = case((has_word("q", t), quoted(t)) for t in sorted(lx.OFF_DOMAIN, key=lambda t: (-len(t), t)))
    shades = case((f"target_color = {quoted(k)}", listed(sorted({*v, k}))) for k, v in DEFAULT.colours.items())
    women = ", ".join(map(quoted, lx.WOMEN_BY_DEFAULT))
    return f"""{source},
cleaned AS (SELECT *, lower({clean('query')}) AS q FROM queries),
parsed AS (
  SELECT *, {category} AS target_category, {gender} AS stated, {colour} AS target_color,
         CASE WHEN NOT ({about}) THEN {off} END AS non_fashion_term, {words('q')} AS tokens FROM cleaned),
intents AS (
  SELECT *, coalesce(stated, CASE WHEN target_category IN ({women}) THEN 'Women' END) AS target_gender,
         CASE WHEN target_color IS NULL THEN []::VARCHAR[] ELSE coalesce({shades}, [target_color]) END AS shades FROM parsed)"""


LEXICON = (
    "lexicon(ord, name, stem, synonyms, stems, context) AS (VALUES "
    + ", ".join(f"({i}, {quoted(c.name)}, {quoted(stem_of(c.name))}, {listed(c.synonyms)}, {listed(map(stem_of, c.synonyms))}, {quoted(c.context)})" for i, c in enumerate(DEFAULT.categories))
    + ")"
)


def lookup(name: str, source: str) -> str:
    """CTEs: ``name`` has c and the entry for each different c of ``source``."""
    return f"""{name}_c AS (SELECT DISTINCT c, {stem('c')} AS s FROM ({source}) WHERE c <> ''),
{name} AS (
  SELECT c, name AS entry, synonyms, context FROM (
    SELECT c, name, synonyms, context, ord, CASE WHEN name = c THEN 1 WHEN name = s THEN 2
      WHEN stem = s OR list_contains(synonyms, c) OR list_contains(stems, s) THEN 3
      WHEN contains(c, name) OR contains(name, s) OR len(list_filter(synonyms, lambda y: contains(c, y) OR contains(y, c))) > 0 THEN 4 END AS tier
    FROM {name}_c, lexicon)
  WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY tier, ord) = 1)"""


def pick(values: list[str], key: str = "p_partkey") -> str:
    return f"{listed(values)}[{key} % {len(values)} + 1]"


PRODUCTS = f"""products AS (
  SELECT p_partkey AS id, p_name AS title, {pick(['Men', 'Women', 'Unisex', 'Boys', 'Girls'])} AS gender, {pick(['Accessories', 'Apparel', ''])} AS master, p_brand AS sub,
         upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS article,
         CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'Blue' ELSE '' END AS colour, {pick(['Summer', 'Fall', 'Winter', 'Spring'])} AS season,
         CAST(2010 + p_partkey % 8 AS VARCHAR) AS year, {pick(['Casual', 'Formal', ''])} AS usage,
         p_name || ' of type ' || p_type || '. It has size ' || p_size || '!' AS description FROM part)"""

#: Every product has a gender, a season and a title, so clauses that need them are always there.
GRAMS = f"""{LEXICON}, {PRODUCTS},
cp AS (
  SELECT id, {clean('title')} AS title, lower({clean('title')}) AS ltitle, {clean('gender')} AS gender, lower({clean('gender')}) AS lgender,
         {clean('master')} AS master, {clean('sub')} AS sub, {clean('article')} AS article, lower({clean('article')}) AS larticle, lower({clean('colour')}) AS colour,
         lower({clean('season')}) AS season, {clean('year')} AS year, lower({clean('usage')}) AS usage, {clean('description')} AS description FROM products),
{lookup('la', 'SELECT larticle AS c FROM cp')}, {lookup('ls', 'SELECT lower(sub) AS c FROM cp')},
w AS (
  SELECT cp.*, {words('ltitle')} AS ws, CASE WHEN lgender = 'unisex' THEN '' ELSE lgender END AS g, coalesce(la.synonyms, []::VARCHAR[]) AS syn, la.synonyms AS asyn, la.context AS acontext
  FROM cp LEFT JOIN la ON la.c = larticle),
n AS (
  SELECT *, list_sort(list_distinct(list_concat(ws, syn))) AS unigrams,
    list_sort(list_distinct(list_filter(list_concat({ngrams('ws', 2)}, [
      CASE WHEN colour <> '' AND larticle <> '' THEN colour || ' ' || larticle END, CASE WHEN g <> '' AND larticle <> '' THEN g || ' ' || larticle END,
      CASE WHEN usage <> '' AND larticle <> '' THEN usage || ' ' || larticle END, CASE WHEN colour <> '' AND usage <> '' THEN colour || ' ' || usage END],
      list_transform(syn, lambda y: CASE WHEN colour <> '' THEN colour || ' ' || y END), list_transform(syn, lambda y: CASE WHEN g <> '' THEN g || ' ' || y END)), lambda x: x IS NOT NULL))) AS bigrams,
    list_sort(list_distinct(list_filter(list_concat({ngrams('ws', 3)}, [
      CASE WHEN g <> '' AND colour <> '' AND larticle <> '' THEN g || ' ' || colour || ' ' || larticle END,
      CASE WHEN usage <> '' AND colour <> '' AND larticle <> '' THEN usage || ' ' || colour || ' ' || larticle END,
      CASE WHEN g <> '' AND usage <> '' AND larticle <> '' THEN g || ' ' || usage || ' ' || larticle END],
      list_transform(syn, lambda y: CASE WHEN g <> '' AND colour <> '' THEN g || ' ' || colour || ' ' || y END)), lambda x: x IS NOT NULL))) AS trigrams
  FROM w)"""


def parts(*xs: str) -> str:
    return f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"


def given(x: str, out: str | None = None) -> str:
    return f"CASE WHEN {x} <> '' THEN {out or x} END"


CHUNKS = f"""{GRAMS},
ph AS (
  SELECT n.*, coalesce(asyn, ls.synonyms) AS msyn, coalesce(acontext, ls.context) AS mcontext,
    array_to_string({parts(given('colour'), given('g', "g || '''s'"), "CASE WHEN larticle <> '' THEN larticle WHEN sub <> '' THEN lower(sub) END")}, ' ') AS phrase,
    {parts(given('colour', "colour || ' colored'"), given('usage', "'designed for ' || usage || ' wear'"), "'suitable for ' || season || ' ' || year", given('larticle', "larticle || ' fashion product'"))} AS clauses,
    list_concat(bigrams[1:6], trigrams[1:4]) AS phrases
  FROM n LEFT JOIN ls ON ls.c = lower(sub)),
texts AS (
  SELECT id, title, list_filter([
    {{'kind': 'identity_category', 'text': CASE WHEN phrase <> '' AND NOT contains(ltitle, phrase) THEN 'A photo of ' || title || ', a ' || phrase || '.' ELSE 'A photo of ' || title || '.' END}},
    {{'kind': 'style_attributes', 'text': title || '. ' || array_to_string(clauses, ', ') || '.'}},
    {{'kind': 'ngram_context', 'text': CASE WHEN len(phrases) > 0 THEN 'Key product phrases and n-grams: ' || array_to_string(phrases, ', ') || '.' END}},
    {{'kind': 'semantic_context', 'text': 'Contextual fashion ontology for ' || title || ': ' || array_to_string({parts(
        "CASE WHEN master <> '' OR sub <> '' THEN 'Category hierarchy: ' || array_to_string(" + parts(given('master'), given('sub'), given('article')) + ", ' > ') END",
        "'Item meaning and synonyms: ' || array_to_string(msyn[1:4], ', ')", "'Styling context: ' || mcontext", "'Target audience: ' || gender")}, '. ') || '.'}},
    {{'kind': 'description_detail', 'text': CASE WHEN lower(description) <> ltitle AND length(description) > 10 THEN description END}}], lambda x: x.text IS NOT NULL) AS chunks
  FROM ph),
points AS (
  SELECT id * 1000 + k - 1 AS point_id, id AS product_id, CAST(k - 1 AS BIGINT) AS chunk_id, chunks[k].kind AS chunk_type, chunks[k].text AS chunk_text
  FROM (SELECT id, chunks, unnest(range(1, len(chunks) + 1)) AS k FROM texts))"""


# -- context ---------------------------------------------------------------------------------------------------------


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) > 0"


def context_ctes(rows: str) -> str:
    """``rows`` gives products' texts in lower case, gender, and the query's intent; scored has scores and multipliers."""
    excluded = lambda c: [t for k in DEFAULT.incompatible.get(c.name, ()) if (o := DEFAULT.named(k)) for t in o.terms]
    cats = ", ".join(f"({quoted(c.name)}, {listed(c.terms)}, {listed(excluded(c))})" for c in DEFAULT.categories)
    outside = " OR ".join(
        f"(target_category IN ({', '.join(map(quoted, cs))}) AND master <> '' AND master NOT IN ({', '.join(map(quoted, ms))}))" for cs, ms in lx.MASTER_GROUPS
    )
    other = " OR ".join(f"(target_color <> {quoted(k)} AND raw_colour IN ({', '.join(map(quoted, v))}))" for k, v in DEFAULT.colours.items())
    edge = f"[^{WORD}]"
    # a pattern that isn't constant is compiled for each row, so rows without the term are ruled out before
    named = lambda t: f"CASE WHEN contains({t}, target_color) THEN regexp_matches({t}, '(^|{edge})' || target_color || '($|{edge})') ELSE false END"
    return f"""cr AS ({rows}), cats(cat, terms, banned) AS (VALUES {cats}),
c1 AS (
  SELECT *, concat_ws(' ', name, article, sub, master, colour, usage, chunk) AS f, {words('name')} AS nw, {words('chunk')} AS cw, {ngrams('tokens', 2)} AS q2, {ngrams('tokens', 3)} AS q3,
         {either('tokens', stems('tokens'))} AS qs FROM cr),
c2 AS (
  SELECT *, {either(words(clean('lower(f)')), stems(words(clean('lower(f)'))))} AS fs, list_concat({ngrams('nw', 2)}, {ngrams('cw', 2)}, [colour || ' ' || article, usage || ' ' || article]) AS g2,
         list_concat({ngrams('nw', 3)}, {ngrams('cw', 3)}) AS g3, coalesce(terms, []::VARCHAR[]) AS valid, coalesce(banned, []::VARCHAR[]) AS excluded,
         {either(words(clean("concat_ws(' ', article, sub)")), stems(words(clean("concat_ws(' ', article, sub)"))))} AS near,
         {either(words(clean("concat_ws(' ', article, sub, master, name)")), stems(words(clean("concat_ws(' ', article, sub, master, name)"))))} AS wide FROM c1 LEFT JOIN cats ON cat = target_category),
c3 AS (
  SELECT *, least(1.0::DOUBLE, len(list_intersect(qs, fs))::DOUBLE / greatest(1, len(tokens))) AS u,
    CASE WHEN len(q2) > 0 THEN len(list_filter(q2, lambda x: list_contains(g2, x) OR contains(f, x) OR contains(f, array_to_string({stems("string_split(x, ' ')")}, ' '))))::DOUBLE / len(q2) END AS b0,
    CASE WHEN len(q3) > 0 THEN len(list_filter(q3, lambda x: list_contains(g3, x) OR contains(f, x)))::DOUBLE / len(q3) END AS t0,
    CASE WHEN NOT contains(f, q) THEN 0.0 WHEN regexp_matches(f, '(^|{edge})' || q || '($|{edge})') THEN 1.0 ELSE 0.0 END::DOUBLE AS e,
    CASE WHEN target_gender = 'Women' AND gender IN ('Men', 'Boys') THEN 0 WHEN target_gender = 'Women' AND gender IN ('Women', 'Girls') THEN 1.1
         WHEN target_gender = 'Men' AND gender IN ('Women', 'Girls') THEN 0 WHEN target_gender = 'Men' AND gender IN ('Men', 'Boys') THEN 1.1 ELSE 1 END::DOUBLE AS g,
    CASE WHEN target_color IS NULL THEN 1 WHEN list_contains(shades, raw_colour) OR {named('name')} OR {named('chunk')} THEN 1.35 WHEN {other} THEN 0 ELSE 0.25 END::DOUBLE AS k,
    CASE WHEN target_category IS NULL THEN 1 WHEN ({overlap('excluded', 'near')} AND NOT {overlap('valid', 'near')}) OR {outside} THEN 0
         WHEN target_category = 'dresses' THEN CASE WHEN contains(article, 'dress') OR contains(sub, 'dress') OR contains(name, 'dresses') OR contains(name, 'gown') OR contains(name, 'sundress') OR contains(name, 'frock') THEN 1.3 ELSE 0 END
         WHEN {overlap('valid', 'wide')} THEN 1.25 ELSE 0.6 END::DOUBLE AS c FROM c2),
c4 AS (SELECT *, coalesce(b0, u) AS b, coalesce(t0, b0, u) AS t FROM c3),
context AS (
  SELECT *, len(tokens) > 0 AND (g = 0 OR k = 0 OR c = 0) AS out, CASE WHEN len(tokens) = 0 THEN 0.5::DOUBLE WHEN g = 0 OR k = 0 OR c = 0 THEN 0.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.35 * u + 0.35 * b + 0.15 * t + 0.15 * e) * (g * c * k))) END AS ngram FROM c4)"""


def product_texts(chunk: str) -> str:
    low = lambda x: f"lower({clean(x)})"
    return f"id, {low('title')} AS name, {low('article')} AS article, {low('sub')} AS sub, {low('master')} AS master, {low('colour')} AS colour, {low('usage')} AS usage, {low(chunk)} AS chunk, gender, lower(trim(colour)) AS raw_colour"


CONTEXT = f"""WITH {intent_ctes()}, {PRODUCTS},
{context_ctes(f"SELECT {product_texts("'A photo of ' || title || '.'")}, query_id, q, tokens, target_category, target_gender, target_color, shades FROM products, intents")}"""

BEST = f"""{scored(2)}, {hits(120)},
ih AS (SELECT point_id // 4 AS product_id, greatest(0.0::DOUBLE, max(score)) AS image_score, min(rank) AS early FROM h WHERE NOT is_title GROUP BY 1),
ch AS (
  SELECT point_id // 4 AS product_id, max(score) AS text_score, arg_max('chunk ' || point_id, score) AS best_chunk, min(rank) AS late
  FROM h WHERE is_title AND point_id // 4 <> 0 GROUP BY 1),
best AS (
  SELECT coalesce(ih.product_id, ch.product_id) AS product_id, coalesce(image_score, 0) AS image_score,
    CASE WHEN early IS NULL OR text_score > 0 THEN greatest(0.0::DOUBLE, coalesce(text_score, 0)) ELSE 0 END AS text_score,
    CASE WHEN early IS NULL OR text_score > 0 THEN coalesce(best_chunk, '') ELSE '' END AS best_chunk, coalesce(early, 1073741824 + late) AS seq
  FROM ih FULL JOIN ch ON ih.product_id = ch.product_id)"""


def by_query(mode: str) -> str:
    """CTEs of a contextual search: asked has the queries and why some are turned away, cand the candidates, x the ranked rows."""
    if mode == "text":
        asked = """SELECT i.*, embedding AS vector, CASE WHEN i.query_id = 10 THEN 'out_of_domain' WHEN trim(query) = '' THEN 'empty_query'
           WHEN non_fashion_term IS NOT NULL THEN 'non_fashion_query' END AS why FROM intents i JOIN embeddings ON vec_id = i.query_id"""
        limit, floor = 120, 0.05
    else:
        asked = "SELECT vec_id - 2 AS query_id, embedding AS vector, NULL::VARCHAR AS why FROM embeddings WHERE vec_id % 20 = 2"
        limit, floor = 50, 0.2
    product = f"id, coalesce(title, 'Product #' || product_id) AS title, {', '.join(f"coalesce({c}, '') AS {c}" for c in ('article', 'sub', 'master', 'colour', 'usage', 'gender'))}"
    start = f"""WITH {intent_ctes()}, {PRODUCTS},
asked AS ({asked}),
cs AS (SELECT query_id, vec_id AS point_id, vec_id // 4 AS product_id, {dot('embedding', 'vector')} AS score FROM embeddings, asked WHERE why IS NULL),
ci AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM cs WHERE point_id % 4 = 0 QUALIFY rank <= {limit}),
cc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM cs WHERE point_id % 4 <> 0 QUALIFY rank <= {2 * limit}),
ch AS (
  SELECT query_id, product_id, max(score) AS text_score, arg_max('chunk ' || point_id, score) AS best_chunk, min(rank) AS late FROM cc WHERE product_id <> 0 GROUP BY 1, 2),
best AS (
  SELECT coalesce(ci.query_id, ch.query_id) AS query_id, coalesce(ci.product_id, ch.product_id) AS product_id, greatest(0.0::DOUBLE, coalesce(ci.score, 0)) AS image_score,
    CASE WHEN rank IS NULL OR text_score > 0 THEN greatest(0.0::DOUBLE, coalesce(text_score, 0)) ELSE 0 END AS text_score,
    CASE WHEN rank IS NULL OR text_score > 0 THEN coalesce(best_chunk, '') ELSE '' END AS best_chunk, coalesce(rank, 1073741824 + late) AS seq
  FROM ci FULL JOIN ch ON ci.query_id = ch.query_id AND ci.product_id = ch.product_id),
cand AS (SELECT b.*, max(image_score) OVER (PARTITION BY query_id) AS best_image, {product} FROM best b LEFT JOIN products ON id = product_id)"""
    if mode == "text":
        rows = f"SELECT {product_texts('best_chunk')}, title, product_id, image_score, text_score, best_chunk, seq, best_image, c.query_id, q, tokens, target_category, target_gender, target_color, shades FROM cand c JOIN asked USING (query_id)"
        mixed = f"""{context_ctes(rows)},
b1 AS (SELECT *, 0.75 * text_score + 0.25 * ({calibrate('image_score')}) AS base FROM context),
b2 AS (SELECT *, round(CASE WHEN out THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7 * base + 0.3 * CASE WHEN ngram > 0 THEN ngram ELSE base END)) END, 4) AS score FROM b1)"""
        passed = "true"
    else:
        mixed = f"b2 AS (SELECT *, round(0.75 * image_score + 0.25 * ({calibrate('text_score')}), 4) AS score FROM cand)"
        passed = "best_image >= 0.2::DOUBLE"
    return f"""{start}, {mixed},
v AS (
  SELECT *, row_number() OVER w - 1 AS i, lead(score) OVER w AS nxt, first(score) OVER w AS top FROM b2 WHERE score > 0 AND score >= {floor} AND {passed}
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, seq, product_id)),
e AS (SELECT *, score - nxt >= 0.12::DOUBLE AND i >= 1 AS gap, (score - nxt >= 0.12::DOUBLE AND i >= 1) OR (nxt < greatest({floor}::DOUBLE, top * 0.5) AND i >= 2) AS stop FROM v),
x AS (SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY query_id) AS last FROM e)"""


SHOWN = """SELECT query_id, product_id, title AS name, '/media/images/' || product_id || '.jpg' AS image_url, round(image_score, 4) AS image_score, round(text_score, 4) AS text_score,
  best_chunk AS best_matching_chunk, score, i + 1 AS rank FROM x WHERE i <= coalesce(last, 1073741824) AND i < 10"""

def gates(mode: str) -> str:
    low = "WHEN valid IS NULL AND best_image < 0.2::DOUBLE THEN 'low_similarity_floor' " if mode == "image" else ""
    return f""",
n AS (SELECT query_id, count(*) AS total, max(best_image) AS best_image FROM b2 GROUP BY 1),
k AS (SELECT query_id, count(*) AS valid, min(last) AS last, max(CASE WHEN i = last AND gap THEN i + 1 END) AS gap_rank FROM x GROUP BY 1),
r AS (
  SELECT a.query_id, coalesce(total, 0) AS total, CASE WHEN valid IS NULL THEN 0 ELSE least(coalesce(last + 1, valid), valid, 10) END AS kept, gap_rank,
    CASE WHEN why IS NOT NULL THEN why {low}WHEN valid IS NULL THEN 'all_below_quality_or_incompatible' END AS reason
  FROM asked a LEFT JOIN n ON n.query_id = a.query_id LEFT JOIN k ON k.query_id = a.query_id)
SELECT query_id, total AS total_candidates, kept AS kept_count, total - kept AS eliminated_count, gap_rank IS NOT NULL AS gap_detected, gap_rank, reason,
  coalesce(reason IN ('out_of_domain', 'non_fashion_query', 'low_similarity_floor'), false) AS is_out_of_domain, kept AS total_found FROM r"""


def unified_of_each(queries: str) -> str:
    """CTEs: u has the ten best products of an image search for each row (qid, query)."""
    return f"""s AS (SELECT qid, vec_id AS point_id, vec_id // 2 AS product_id, vec_id % 2 = 1 AS is_title, {dot('embedding', 'query')} AS score FROM embeddings, {queries}),
both_sides AS (SELECT qid, product_id, max(CASE WHEN NOT is_title THEN score END) AS image, max(CASE WHEN is_title THEN score END) AS title FROM s GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) AS rank FROM s QUALIFY rank <= 100),
g AS (
  SELECT qid, product_id, max(CASE WHEN NOT is_title THEN score END) AS image_score, max(CASE WHEN is_title THEN score END) AS title_score, min(rank) AS place FROM h GROUP BY ALL),
im AS (SELECT qid, product_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) AS late FROM s WHERE NOT is_title QUALIFY late <= 100),
m AS (
  SELECT coalesce(g.qid, im.qid) AS qid, coalesce(g.product_id, im.product_id) AS product_id, coalesce(greatest(image_score, im.score), image_score, im.score) AS image_score, title_score,
         coalesce(place, 1073741824 + late) AS seq FROM g FULL JOIN im ON g.qid = im.qid AND g.product_id = im.product_id),
f AS (
  SELECT m.qid, m.product_id, seq, coalesce(image_score, b.image, 0) AS i, coalesce(title_score, b.title, 0) AS t FROM m LEFT JOIN both_sides b ON b.qid = m.qid AND b.product_id = m.product_id),
o AS (SELECT *, round({weighted('i', 't', 'image')}, 4) AS final_score FROM f),
u AS (
  SELECT qid, product_id, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, seq, product_id) AS rank, final_score, round(i, 4) AS image_score, round(t, 4) AS title_score
  FROM o QUALIFY rank <= 10)"""


#: Pictures with the boxes that their detector saw; b has a row for each box.
SKETCHES = f"""k AS (SELECT vec_id AS image_id, label, vec_id * 37 % 1009 AS k FROM embeddings),
k1 AS (SELECT *, 60 + k % 5 * 10 AS width, 50 + k % 3 * 10 AS height, 8 + k % 7 AS x0, 6 + k % 5 AS y0 FROM k),
k2 AS (SELECT *, x0 + 24 + k % 20 AS x1, y0 + 22 + k % 18 AS y1 FROM k1),
sk AS (
  SELECT *, CASE WHEN x0 > 8 THEN x0 ELSE 0 END AS s0, CASE WHEN y0 > 8 THEN y0 ELSE 0 END AS s1, CASE WHEN width - x1 > 8 THEN x1 ELSE width END AS s2,
         CASE WHEN height - y1 > 8 THEN y1 ELSE height END AS s3, (s2 - s0) * (s3 - s1) < 0.95 * width * height AS stands_out FROM k2),
b AS (
  SELECT image_id, width, height, 0::BIGINT AS box_index, x0 - 1.5::DOUBLE AS l, y0 - 1.5::DOUBLE AS t, x1 + 1.5::DOUBLE AS r, y1 + 1.5::DOUBLE AS m, 0.5::DOUBLE + (k % 50) / 100.0::DOUBLE AS confidence,
    {listed(CLASSES)}[(label + k) % {len(CLASSES)} + 1] AS class_name FROM sk WHERE k % 4 <> 3
  UNION ALL SELECT image_id, width, height, 1, 0, 0, width - k % 6, height - k % 4, 0.4::DOUBLE + (k % 60) / 100.0::DOUBLE, {listed(CLASSES)}[(label * 3 + k // 2) % {len(CLASSES)} + 1]
  FROM sk WHERE k % 4 <> 3 AND k % 3 = 0
  UNION ALL SELECT image_id, width, height, 2, 5, 5, 15 + k % 20, 12 + k % 25, 0.9, {listed(CLASSES)}[(k // 3) % {len(CLASSES)} + 1] FROM sk WHERE k % 4 <> 3 AND k % 6 = 0)"""

#: These classes are written here once more, so that a slip in the library shows.
INSIDE = "('backpack', 'umbrella', 'handbag', 'tie', 'suitcase')"
OUTSIDE = """('dog', 'cat', 'bird', 'horse', 'sheep', 'cow', 'elephant', 'bear', 'zebra', 'giraffe', 'car', 'motorcycle', 'airplane', 'bus', 'train', 'truck', 'boat',
    'traffic light', 'fire hydrant', 'stop sign', 'parking meter', 'toilet')"""
BONUS = "CASE WHEN lower(class_name) IN ('handbag', 'backpack', 'tie', 'suitcase', 'shoe', 'dress', 'shirt', 'focused_product') THEN 2 WHEN lower(class_name) = 'person' THEN 1.2 ELSE 0.5 END"
DOMAIN_RULE = f"""dr AS (
  SELECT image_id, bool_or(lower(class_name) IN {INSIDE} OR lower(class_name) = 'person') AS seen, bool_or(lower(class_name) IN {INSIDE}) AS has_inside,
    arg_max(lower(class_name), {{'c': confidence, 'i': -box_index}}) FILTER (WHERE lower(class_name) IN {OUTSIDE} AND confidence >= 0.65::DOUBLE) AS entity FROM b GROUP BY image_id)"""


def crop_of(a: str, c: str, d: str, e: str) -> str:
    """Columns p0 to p3 of a padded box."""
    w, h = f"({d} - {a}) * 0.05::DOUBLE", f"({e} - {c}) * 0.05::DOUBLE"
    return f"""trunc(greatest(0, {a} - {w}))::INT AS p0, trunc(greatest(0, {c} - {h}))::INT AS p1,
    trunc(least(width, {d} + {w}))::INT AS p2, trunc(least(height, {e} + {h}))::INT AS p3"""


def colour_vector(area: str, part: str) -> str:
    """Shares of two colours as a unit vector of 64 numbers: ``part`` pixels of the thing, the rest of ``area`` of the ground."""
    side = lambda cell, n: f"CASE WHEN i = {cell} THEN ({n} / sqrt(({part})::DOUBLE * ({part}) + (({area}) - ({part}))::DOUBLE * (({area}) - ({part}))))::FLOAT ELSE 0 END"
    return f"list_transform(range(0, 64), lambda i: ({side('thing', part)} + {side('ground', f'({area} - ({part}))')})::FLOAT)"


IMAGES = f"""WITH {SKETCHES}, {DOMAIN_RULE},
pics AS (
  SELECT *, 16 * (k // 16 % 2) + 4 * (k // 4 % 2) + k % 2 AS dark, 16 * (2 + k // 32 % 2) + 4 * (2 + k // 8 % 2) + 2 + k // 2 % 2 AS light FROM sk WHERE image_id % 20 = 0),
pv AS (
  SELECT *, {colour_vector('width * height', '(x1 - x0) * (y1 - y0)')} AS vector
  FROM (SELECT *, CASE WHEN k % 4 = 1 THEN light ELSE dark END AS ground, CASE WHEN k % 4 = 1 THEN dark ELSE light END AS thing FROM pics) WHERE k % 11 <> 0),
l AS (SELECT {listed(LABELS)}[vec_id + 1] AS label, embedding FROM embeddings WHERE vec_id < {len(LABELS)}),
zs AS (SELECT image_id, l.label, {dot('vector', 'l.embedding')} AS s FROM pv, l),
zx AS (SELECT *, exp((s - max(s) OVER (PARTITION BY image_id)) / 0.05::DOUBLE) AS e FROM zs),
zp AS (SELECT *, e / sum(e) OVER (PARTITION BY image_id) AS p FROM zx),
za AS (
  SELECT image_id, arg_max(label, p) AS top_label, arg_max(label, p) IN ('sports_ball', 'animal', 'vehicle', 'food') AND max(p) >= 0.5 AND max(CASE WHEN label = 'fashion' THEN p END) < 0.25 AS label_ood FROM zp GROUP BY 1),
ru AS (
  SELECT pv.*, label_ood, coalesce(NOT seen AND entity IS NOT NULL, false) AS detector_ood, NOT coalesce(has_inside, false) AS bare, (seen IS NULL OR (NOT seen AND entity IS NULL)) AND label_ood AS by_label,
    CASE WHEN NOT seen THEN entity END AS own_entity, replace(top_label, '_', ' ') AS top_label
  FROM pv LEFT JOIN dr USING (image_id) JOIN za USING (image_id)),
ro AS (SELECT *, detector_ood OR by_label AS off, coalesce(own_entity, CASE WHEN by_label THEN top_label END) AS detected_entity FROM ru),
every AS (
  SELECT b.* FROM b JOIN ro USING (image_id)
  UNION ALL SELECT image_id, width, height, (SELECT count(*) FROM b WHERE b.image_id = ro.image_id), s0, s1, s2, s3, 0.88::DOUBLE, 'focused_product' FROM ro WHERE NOT off AND bare AND stands_out),
ch AS (
  SELECT every.*, CASE WHEN k % 5 = 4 THEN box_index = 1 ELSE false END AS wanted FROM every JOIN ro USING (image_id) WHERE NOT off OR (k % 5 = 4 AND box_index = 1)
  QUALIFY row_number() OVER (PARTITION BY every.image_id ORDER BY wanted DESC, (r - l) * (m - t) * {BONUS} * confidence DESC, box_index) = 1),
cp AS (SELECT ch.*, {crop_of('l', 't', 'r', 'm')} FROM ch),
cr AS (SELECT cp.image_id, p0, p1, p2, p3 FROM cp JOIN ro USING (image_id) WHERE NOT off AND (r - l) * (m - t) < 0.95 * cp.width * cp.height AND p2 - p0 > 20 AND p3 - p1 > 20),
cv AS (
  SELECT image_id, {colour_vector('(p2 - p0) * (p3 - p1)', 'greatest(0, least(x1, p2) - greatest(x0, p0)) * greatest(0, least(y1, p3) - greatest(y0, p1))')} AS vector FROM cr JOIN pv USING (image_id)),
qs AS (
  SELECT {{'image_id': image_id, 'source': 'original'}} AS qid, vector AS query FROM pv UNION ALL SELECT {{'image_id': image_id, 'source': 'crop'}}, vector FROM cv),
{unified_of_each('qs')},
tops AS (
  SELECT qid.image_id AS image_id, max(CASE WHEN qid.source = 'original' THEN image_score END) AS oi, max(CASE WHEN qid.source = 'crop' THEN image_score END) AS ci FROM u WHERE rank = 1 GROUP BY 1),
picked AS (
  SELECT image_id, CASE WHEN stays THEN 'original' ELSE 'crop' END AS source, coalesce(CASE WHEN stays THEN oi ELSE ci END, 0) >= 0.3::DOUBLE AS sure
  FROM (SELECT *, ci IS NULL OR coalesce(oi, -1) >= 0.25::DOUBLE OR coalesce(oi, -1) >= ci AS stays FROM tops)),
facts AS (SELECT ro.*, source, NOT sure AND (off OR label_ood) AS ood FROM ro JOIN picked USING (image_id)),
shown AS (SELECT u.*, fa.image_id, fa.source FROM u JOIN facts fa ON u.qid.image_id = fa.image_id AND u.qid.source = fa.source WHERE NOT ood),
v AS (
  SELECT *, row_number() OVER w - 1 AS i, lead(final_score) OVER w AS nxt, first(final_score) OVER w AS top FROM shown WHERE final_score > 0 AND final_score >= 0.05::DOUBLE
  WINDOW w AS (PARTITION BY image_id ORDER BY final_score DESC, rank, product_id)),
e AS (
  SELECT *, final_score - nxt >= 0.03::DOUBLE AND i >= 1 AS gap, (final_score - nxt >= 0.03::DOUBLE AND i >= 1) OR (nxt < greatest(0.05::DOUBLE, top * 0.5) AND i >= 2) AS stop FROM v),
x AS (SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY image_id) AS last FROM e)"""


def word_query(expression: str) -> str:
    return f"WITH t AS (SELECT conv_id, turn, {words(f'lower({clean("text")})')} AS w FROM conversations) SELECT conv_id, turn, array_to_string({expression}, '|') AS words FROM t"


ORACLE_SQL = {
    "unified_image_weighted": unified("image", "weighted_sum"),
    "unified_text_weighted": unified("text", "weighted_sum"),
    "unified_score_fusion": unified("image", "score_fusion"),
    "unified_rrf": unified("image", "rrf"),
    "unified_custom_weights": unified("text", "weighted_sum", 20, (0.5, 0.5)),
    "dot_topk": f"WITH {scored()}, {hits(50)} SELECT point_id, round(score, 6) AS score, rank FROM h",
    "l2_norm_check": f"""SELECT vec_id, round(sqrt({dot('embedding', 'embedding')}), 6) AS norm,
  round(embedding[1]::DOUBLE / sqrt({dot('embedding', 'embedding')}), 6) AS first FROM embeddings""",
    "batch_query_topk": f"""SELECT a.vec_id AS query_id, b.vec_id AS point_id, round({dot('a.embedding', 'b.embedding')}, 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {dot('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""",
    "group_modality_scores": f"WITH {scored()}, {hits(100)}, {GROUPED} SELECT product_id, round(image_score, 6) AS image_score, round(title_score, 6) AS title_score, image_rank, title_rank FROM g",
    "counterpart_fill": f"""WITH {scored()}, {hits(100)}, {GROUPED}
SELECT product_id, round(coalesce(image_score, image, 0), 6) AS image_score, round(coalesce(title_score, title, 0), 6) AS title_score FROM g LEFT JOIN both_sides USING (product_id)""",
    "near_identical_rule": f"WITH {scored()} SELECT * FROM (SELECT product_id, round({weighted('image', 'title', 'image')}, 4) AS score FROM both_sides) WHERE score > 0.2",
    "calibrate_scores": f"WITH {scored()} SELECT product_id, round({calibrate('image')}, 4) AS image, round({calibrate('title')}, 4) AS title FROM both_sides",
    "blend_scores": f"""WITH {scored()}, b AS (
  SELECT product_id, 0.75 * image + 0.25 * ({calibrate('title')}) AS im, 0.75 * title + 0.25 * ({calibrate('image')}) AS tx,
         CASE WHEN product_id % 3 = 0 THEN 0 ELSE (product_id % 10) / 10.0 END::DOUBLE AS ng FROM both_sides)
SELECT product_id, round(im, 4) AS image_mode, round(tx, 4) AS text_mode,
  round(CASE WHEN product_id % 7 = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7 * tx + 0.3 * CASE WHEN ng > 0 THEN ng ELSE tx END)) END, 4) AS with_context FROM b""",
    "cliff_cutoff": f"{CLIFF} SELECT label, point_id, score, i + 1 AS rank FROM x WHERE i <= coalesce(last, 1073741824) AND i < {RULE.most}",
    "cliff_metadata": f"""{CLIFF},
a AS (
  SELECT label, count(*) AS valid, min(last) AS last, max(CASE WHEN i = last AND gap THEN i + 1 END) AS gap_rank, max(CASE WHEN i = last AND gap THEN round(score - nxt, 4) END) AS gap_size
  FROM x GROUP BY label),
t AS (SELECT label, count(*) AS total FROM l GROUP BY label),
k AS (SELECT t.*, a.*, least(coalesce(last + 1, coalesce(valid, 0)), coalesce(valid, 0), {RULE.most}) AS kept FROM t LEFT JOIN a ON a.label = t.label)
SELECT label, total AS total_candidates, kept AS kept_count, total - kept AS eliminated_count, gap_rank IS NOT NULL AS gap_detected, gap_rank, gap_size,
  CASE WHEN coalesce(valid, 0) = 0 THEN 'all_below_quality_or_incompatible' END AS reason FROM k""",
    "cliff_whole_list": f"""WITH {scored()},
l AS (SELECT point_id, round(score + 0.2::DOUBLE, 4) AS score FROM s),
v AS (
  SELECT *, row_number() OVER w - 1 AS i, lead(score) OVER w AS nxt, first(score) OVER w AS top FROM l WHERE score > 0 AND score >= {RULE.text_floor} WINDOW w AS (ORDER BY score DESC, point_id)),
e AS (
  SELECT *, score - nxt >= 0.004::DOUBLE AND i >= 1 AS gap, (score - nxt >= 0.004::DOUBLE AND i >= 1) OR (nxt < greatest({RULE.text_floor}::DOUBLE, top * 0.5::DOUBLE) AND i >= 2) AS stop FROM v),
x AS (SELECT *, min(CASE WHEN stop THEN i END) OVER () AS last FROM e),
a AS (
  SELECT count(*) AS valid, min(last) AS last, max(CASE WHEN i = last AND gap THEN i + 1 END) AS gap_rank, max(CASE WHEN i = last AND gap THEN round(score - nxt, 4) END) AS gap_size FROM x),
k AS (SELECT *, (SELECT count(*) FROM l) AS total, least(coalesce(last + 1, valid), valid, 10) AS kept FROM a)
SELECT total AS total_candidates, kept AS kept_count, total - kept AS eliminated_count, gap_rank IS NOT NULL AS gap_detected, gap_rank, gap_size,
  CASE WHEN total = 0 THEN 'empty_input' WHEN valid = 0 THEN 'all_below_quality_or_incompatible' END AS reason FROM k""",
    "image_floor_gate": f"""WITH {scored()}, r AS (SELECT product_id, round(image, 6) AS image_score, product_id < 40 AS part FROM both_sides)
SELECT product_id, image_score FROM (SELECT *, max(image_score) OVER (PARTITION BY part) AS top FROM r) WHERE top >= 0.38""",
    "ensemble_mean_vector": """WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM e GROUP BY label, pos)
SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 4) AS value FROM m""",
    "zero_shot_softmax": f"""WITH l AS (SELECT {listed(LABELS)}[vec_id + 1] AS label, embedding FROM embeddings WHERE vec_id < {len(LABELS)}),
s AS (SELECT vec_id, l.label, {dot('e.embedding', 'l.embedding')} AS s FROM embeddings e, l),
x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) / 0.05::DOUBLE) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x),
a AS (SELECT vec_id AS image_id, arg_max(label, p) AS top_label, max(p) AS top_p, max(CASE WHEN label = 'fashion' THEN p END) AS home FROM p GROUP BY vec_id)
SELECT image_id, top_label, round(top_p, 4) AS top_p, top_label IN ('sports_ball', 'animal', 'vehicle', 'food') AND top_p >= 0.5 AND home < 0.25 AS is_ood FROM a""",
    "crop_arbitration": f"""WITH r AS (
  SELECT source, (a.vec_id - shift) AS image_id, b.vec_id AS product_id, {dot('a.embedding', 'b.embedding')} AS score,
         row_number() OVER (PARTITION BY source, a.vec_id ORDER BY {dot('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
  FROM (VALUES ('original', 0), ('crop', 1)) AS v(source, shift), embeddings a, embeddings b WHERE a.vec_id >= shift AND (a.vec_id - shift) % 20 = 0 AND b.vec_id <> a.vec_id QUALIFY rank <= 3),
t AS (SELECT image_id, max(CASE WHEN source = 'original' THEN score END) AS o, max(CASE WHEN source = 'crop' THEN score END) AS c FROM r WHERE rank = 1 GROUP BY image_id),
d AS (SELECT *, c IS NULL OR coalesce(o, -1) >= 0.4 OR coalesce(o, -1) >= c AS stays FROM t)
SELECT r.image_id, source, rank, product_id, round(score, 6) AS image_score, coalesce(CASE WHEN stays THEN o ELSE c END, 0) >= 0.35 AS in_domain_by_match
FROM r JOIN d ON d.image_id = r.image_id AND (source = 'original') = stays""",
    "clean_text_documents": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "strip_html_pages": f"SELECT page_id, {clean('html')} AS clean FROM pages",
    "tokens": word_query("w"),
    "stems": word_query(stems("w")),
    "token_stem_union": word_query(union("w", stems("w"))),
    "bigrams": word_query(ngrams("w", 2)),
    "trigrams": word_query(ngrams("w", 3)),
    "standardize_titles": "SELECT p_partkey AS id, p_name || ' ' || p_brand AS title FROM part WHERE p_partkey % 9 <> 0",
    "json_extract": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events",
    "json_descriptions": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS description FROM part",
    "request_parse": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS query, CASE WHEN event_id % 5 = 0 THEN 10 ELSE event_id % 20 END AS top_k FROM events",
    "query_intent": f"""WITH {intent_ctes(ASKED)} SELECT query_id, target_category, target_gender, target_color, array_to_string(shades, '|') AS shades,
  non_fashion_term IS NOT NULL AS is_non_fashion_query, non_fashion_term, array_to_string(tokens, '|') AS tokens FROM intents""",
    "prompt_templates": f"""WITH {ASKED}, {LEXICON}, {lookup('lq', 'SELECT lower(trim(query)) AS c FROM queries')},
p AS (SELECT DISTINCT query, trim(query) AS q, list_filter(synonyms, lambda y: NOT contains(lower(trim(query)), y))[1:2] AS also, context FROM queries LEFT JOIN lq ON c = lower(trim(query)))
SELECT query, CASE WHEN q = '' THEN 'fashion item' ELSE array_to_string({parts("q", "'a photo of ' || q", "'a close-up photo of ' || q", "q || ', stylish fashion apparel product'",
    "CASE WHEN len(also) > 0 THEN 'a photo of ' || q || ', also known as ' || array_to_string(also, ', ') END", "q || ', ' || context")}, '|') END AS prompts FROM p""",
    "lexicon_lookup": f"""WITH {LEXICON}, {PRODUCTS},
k AS (SELECT DISTINCT article AS category FROM products UNION ALL SELECT unnest(['Jeans', 'Sports Shoes', 'Running Shoes', 'steel bolt', 'Dress', 'Watches', '', 'Denim', 'Sweatshirts'])),
{lookup('lk', 'SELECT lower(trim(category)) AS c FROM k')} SELECT category, entry FROM k LEFT JOIN lk ON c = lower(trim(category))""",
    "attribute_ngrams": f"WITH {GRAMS} SELECT id, array_to_string(unigrams, '|') AS unigrams, array_to_string(bigrams, '|') AS bigrams, array_to_string(trigrams, '|') AS trigrams FROM n",
    "product_chunks": f"WITH {CHUNKS} SELECT point_id, product_id, chunk_id, chunk_type, chunk_text FROM points",
    "chunk_type_counts": f"WITH {CHUNKS} SELECT chunk_type, count(*) AS n, avg(length(chunk_text))::DECIMAL(18, 4)::DOUBLE AS length FROM points GROUP BY chunk_type",
    "best_chunk_per_product": f"WITH {BEST} SELECT product_id, round(image_score, 6) AS image_score, round(text_score, 6) AS text_score, best_chunk FROM best",
    "context_multipliers": f"{CONTEXT} SELECT query_id, id, g AS gender_multiplier, k AS color_multiplier, c AS category_multiplier FROM context",
    "ngram_context_score": f"""{CONTEXT} SELECT query_id, id, round(ngram, 6) AS score, out AS is_disqualified, round(u, 3) AS unigram_recall, round(b, 3) AS bigram_score,
  round(t, 3) AS trigram_score, e = 1 AS exact_match FROM context""",
    "contextual_search": f"{by_query('text')} {SHOWN}",
    "contextual_gates": f"{by_query('text')} {gates('text')}",
    "contextual_search_image": f"{by_query('image')} {SHOWN}",
    "contextual_gates_image": f"{by_query('image')} {gates('image')}",
    "unified_payload": f"""WITH {PRODUCTS}, qs AS (SELECT vec_id AS qid, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), {unified_of_each('qs')}
SELECT qid AS query_id, product_id, rank, coalesce(title, 'Product #' || product_id) AS name, '/media/images/' || product_id || '.jpg' AS image_url, coalesce(gender, '') AS gender,
  coalesce(article, '') AS "articleType", coalesce(usage, '') AS usage, final_score, image_score, title_score AS text_score FROM u LEFT JOIN products ON id = product_id""",
    "image_pipeline": f"""{IMAGES} SELECT image_id, source, product_id, i + 1 AS rank, final_score, image_score, title_score FROM x WHERE i <= coalesce(last, 1073741824) AND i < 10""",
    "image_pipeline_report": f"""{IMAGES},
kk AS (SELECT image_id, count(*) AS valid, min(last) AS last, max(CASE WHEN i = last AND gap THEN i + 1 END) AS gap_rank FROM x GROUP BY image_id),
n AS (SELECT image_id, count(*) AS total FROM shown GROUP BY image_id),
bx AS (
  SELECT every.image_id, string_agg(every.class_name || ':' || (ch.box_index IS NOT NULL), '|' ORDER BY every.box_index) AS boxes
  FROM every LEFT JOIN ch ON ch.image_id = every.image_id AND ch.box_index = every.box_index GROUP BY every.image_id),
c AS (
  SELECT f.image_id, source, ood, detected_entity, coalesce(boxes, '') AS boxes, ch.box_index, p0, concat_ws(',', coalesce(p0, 0), coalesce(p1, 0), coalesce(p2, f.width), coalesce(p3, f.height)) AS crop_box,
    coalesce(total, 0) AS total, CASE WHEN valid IS NULL THEN 0 ELSE least(coalesce(last + 1, valid), valid, 10) END AS kept, gap_rank, valid
  FROM facts f LEFT JOIN n USING (image_id) LEFT JOIN kk USING (image_id) LEFT JOIN bx USING (image_id) LEFT JOIN ch USING (image_id) LEFT JOIN cr USING (image_id))
SELECT image_id, source, ood AS is_out_of_domain, detected_entity, boxes AS detected_boxes, box_index, p0 IS NOT NULL AS crop_applied, crop_box, total AS total_candidates, kept AS kept_count,
  total - kept AS eliminated_count, gap_rank IS NOT NULL AS gap_detected, gap_rank,
  CASE WHEN ood THEN 'out_of_domain' WHEN total = 0 THEN 'no_matches' WHEN valid IS NULL THEN 'all_below_quality_or_incompatible' END AS reason FROM c
UNION ALL SELECT image_id, NULL, false, NULL, NULL, NULL, false, NULL, 0, 0, 0, false, NULL, 'invalid_image' FROM pics WHERE k % 11 = 0""",
    "explode_points": """SELECT 2 * p_partkey + t AS point_id, p_partkey AS product_id, p_name AS name, CASE t WHEN 0 THEN 'image' ELSE 'title' END AS embedding_type
FROM part, (VALUES (0), (1)) AS v(t)""",
    "upsert_latest": """WITH m AS (SELECT (min(event_id) + max(event_id)) / 2 AS middle FROM events),
o AS (SELECT events.* FROM events, m WHERE event_id <= middle QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
n AS (SELECT events.* FROM events, m WHERE event_id > middle QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, event_id, event_type, value FROM n UNION ALL SELECT user_id, event_id, event_type, value FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""",
    "index_stats": f"""WITH {CHUNKS} SELECT 'unified' AS collection, count(*) AS n FROM embeddings UNION ALL SELECT 'image', count(*) FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT 'chunks', count(*) FROM points""",
    "point_lookup": "SELECT vec_id AS point_id, vec_id // 2 AS product_id, vec_id % 2 = 1 AS is_title FROM embeddings WHERE vec_id IN (SELECT p_partkey * 7 FROM part)",
    "semi_valid_products": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT vec_id * 2 FROM embeddings)",
    "anti_rejected_products": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT vec_id * 2 FROM embeddings)",
    "ingest_summary": f"WITH {PRODUCTS} SELECT count(*) FILTER (WHERE usage <> '') > 0 AS success, count(*) FILTER (WHERE usage <> '') AS indexed_count, count(*) AS total_products FROM products",
    "index_build": f"""WITH {CHUNKS}, ready AS (SELECT p_partkey FROM part WHERE p_size % 5 <> 0),
k AS (SELECT count(*) AS n FROM points WHERE product_id IN (FROM ready) AND chunk_type <> 'description_detail'),
runs AS (SELECT 0 AS run, count(*) AS n FROM ready UNION ALL SELECT 1, count(*) FROM part WHERE p_size % 5 <> 0 AND p_size < 10)
SELECT run, runs.n > 0 AS success, runs.n AS indexed_count, runs.n AS total_products, 2 * (SELECT count(*) FROM ready) AS unified, (SELECT count(*) FROM ready) AS image, k.n AS chunks FROM runs, k""",
    "title_vectors": "SELECT p_partkey AS id, p_name AS name, 1.0::DOUBLE AS norm, 64 AS components, true AS same FROM part",
    "prompt_vectors": "SELECT p_name AS query, count(*) AS products, 1 AS vectors, 1.0::DOUBLE AS norm FROM part GROUP BY p_name",
    "catalog_popularity": f"""WITH {PRODUCTS}, s AS (SELECT l_partkey, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey)
SELECT article AS "articleType", count(*) AS products, coalesce(sum(quantity), 0) AS quantity, coalesce(max(orders), 0) AS most_orders FROM products LEFT JOIN s ON id = l_partkey GROUP BY article""",
    "stream_index_counts": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT event_type, count(*) AS users FROM l GROUP BY event_type""",
    "box_selection": f"""WITH {SKETCHES} SELECT image_id, box_index, class_name FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY (r - l) * (m - t) * {BONUS} * confidence DESC, box_index) = 1""",
    "crop_geometry": f"""WITH {SKETCHES}, p AS (SELECT *, {crop_of('l', 't', 'r', 'm')} FROM b)
SELECT image_id, box_index, CASE WHEN (r - l) * (m - t) < 0.95 * width * height AND p2 - p0 > 20 AND p3 - p1 > 20 THEN concat_ws(',', p0, p1, p2, p3) END AS crop FROM p""",
    "detector_domain_rule": f"""WITH {SKETCHES}, {DOMAIN_RULE}
SELECT image_id, NOT seen AND entity IS NOT NULL AS detector_ood, NOT seen AND entity IS NULL AS needs_label, CASE WHEN NOT seen THEN entity END AS entity, has_inside FROM dr""",
    "salient_box": f"WITH {SKETCHES} SELECT image_id, CASE WHEN k % 11 <> 0 AND stands_out THEN concat_ws(',', s0, s1, s2, s3) END AS box FROM sk",
}
ORACLE_SQL["grid_query_topk"] = ORACLE_SQL["batch_query_topk"]
