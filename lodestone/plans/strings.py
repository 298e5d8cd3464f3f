"""Queries: text functions. Texts that need special content are built beside the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import bounded as B
from ..functions import parsing as G
from ..functions import text as T
from ..operators import phrases as H
from ..operators import similar as S
from ..sources.tables import RECIPES_SQL, recipes, table

#: A few written lines, as (id, line), for functions that plain prose does not exercise.
LINES = [
    (1, "1½ cups flour, sifted"), (2, "2 ⅓ tbsp. sugar"), (3, "Bake at 350°F for 25-30 minutes"), (4, "Serves 4 to 6"), (5, "mail me at a.b@example.org or +1 (555) 123-4567"),
    (6, "My name is Ann, 12 Main Street"), (7, "salt to taste"), (8, "Makes 2 dozen"), (9, "cook 1 hour 15 minutes"), (10, "steps 2-4 and 7"), (11, "olive oil"), (12, ""),
    (13, "no recipe of mine"), (14, "Ingredients"), (15, "3/4 cup milk (warm)"), (16, "1-2 eggs"),
]
#: And one line of written kind per part, in both dialects of SQL.
PART_LINE = """CASE p_partkey % 8 WHEN 0 THEN concat(p_size, ' cups ', p_name, ', ', lower(p_type)) WHEN 1 THEN concat(p_size, '-', p_size + 2, ' tbsp. ', p_name)
  WHEN 2 THEN concat('1 1/2 kg ', p_name, ' (optional)') WHEN 3 THEN concat(p_name, ' or oil to taste') WHEN 4 THEN concat('Bake at ', 150 + p_size, '°C for ', p_size, '-', p_size + 5, ' minutes')
  WHEN 5 THEN concat('Serves ', p_size, ', steps 2-', 2 + p_size % 7) WHEN 6 THEN concat('makes ', p_size, ' dozen ', p_name, '; my Ann lives at ', p_size + 1, ' Long ', p_name, ' Rd.')
  ELSE concat('mail ', replace(p_name, ' ', '.'), '@example.org or 555-123-', 1000 + p_size) END"""


def lines(spark, d):
    """(id, line): the written lines, and one per part."""
    parts = table(spark, d, "part").select((F.col("p_partkey") + 100).alias("id"), F.expr(PART_LINE).alias("line"))
    return spark.createDataFrame(LINES, "id long, line string").unionByName(parts)


L = (
    "l(id, line) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in LINES) + ") v(a, b) "
    "UNION ALL SELECT p_partkey + 100, " + PART_LINE + " FROM part)"
)


def docs(spark, d):
    return table(spark, d, "documents")


@query("str01_canonical")
def str01(spark, d):
    return docs(spark, d).select("doc_id", T.canonical("text").alias("canonical"))


@query("str01_canonical_ascii", r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS canonical FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*')")
def str01b(spark, d):
    return docs(spark, d).filter(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", T.plain(F.col("text")).alias("canonical"))


@query("str02_collapsed", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")
def str02(spark, d):
    return docs(spark, d).select("doc_id", T.collapsed(F.col("text")).alias("t"))


@query("str03_r_vectors", """
SELECT raw, items FROM (VALUES ('c("eggs", "olive oil")', ['eggs', 'olive oil']), ('character(0)', []), ('NA', NULL), ('eggs', ['eggs']), ('c("a \\"b\\"", NA)', ['a "b"', NULL]), ('c("egg",)', NULL), ('c("a" "b")', NULL)) v(raw, items)
UNION ALL SELECT 'c("' || p_name || '", NA, "' || p_type || '")', [p_name, NULL, p_type] FROM part""")
def str03(spark, d):
    rows = [('c("eggs", "olive oil")',), ("character(0)",), ("NA",), ("eggs",), ('c("a \\"b\\"", NA)',), ('c("egg",)',), ('c("a" "b")',)]
    parts = table(spark, d, "part").select(F.concat(F.lit('c("'), "p_name", F.lit('", NA, "'), "p_type", F.lit('")')).alias("raw"))
    return spark.createDataFrame(rows, "raw string").unionByName(parts).select("raw", G.r_vector("raw").alias("items"))


@query("str04_fractions", "WITH " + L + """, g AS (SELECT id, regexp_replace(line, '([0-9])([½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞])', '\\1 \\2', 'g') AS t FROM l)
SELECT id, replace(replace(replace(t, '½', '1/2'), '⅓', '1/3'), '¾', '3/4') AS t FROM g""".replace("\\\\", "\\"))
def str04(spark, d):
    return lines(spark, d).select("id", T.ascii_fractions(F.col("line")).alias("t"))


@query("str05_spacing", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([0-9])([A-Za-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '\)([A-Za-z])', ') \1', 'g')) AS t FROM documents""")
def str05(spark, d):
    return docs(spark, d).select("doc_id", F.md5(G.spaced(F.col("text")).cast("binary")).alias("t"))


@query("str06_leading_unit", "WITH " + L + r""" SELECT id, nullif(regexp_extract(line, '^([0-9 /½⅓¾.-]+)(cups|cup|tbsp|tsp|g|kg|ml|l|oz|lb)\b', 2), '') AS unit FROM l""")
def str06(spark, d):
    return lines(spark, d).select("id", F.nullif(F.regexp_extract("line", G.LEADING_UNIT, 2), F.lit("")).alias("unit"))


@query("str07_preparation", "WITH " + L + r""" SELECT id, regexp_extract(line, '^([^,]*)(?:, *(.*))?$', 1) AS item, nullif(regexp_extract(line, '^([^,]*)(?:, *(.*))?$', 2), '') AS preparation FROM l""")
def str07(spark, d):
    pattern = r"^([^,]*)(?:, *(.*))?$"
    return lines(spark, d).select("id", F.regexp_extract("line", pattern, 1).alias("item"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).alias("preparation"))


@query("str08_sections", """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
m AS (SELECT doc_id, pos, line, min(CASE WHEN contains(line, '|') THEN pos END) OVER (PARTITION BY doc_id) AS header FROM p)
SELECT doc_id, CASE WHEN pos = 1 THEN 'title' WHEN header IS NULL OR pos < header THEN 'intro' ELSE 'list' END AS section, count(*) AS lines FROM m GROUP BY ALL""")
def str08(spark, d):
    ls = F.split("text", "\n")
    header = F.array_position(F.transform(ls, lambda x: x.contains("|")), True)
    rows = docs(spark, d).select("doc_id", header.alias("header"), F.posexplode(ls).alias("p", "line"))
    section = F.when(F.col("p") == 0, "title").when((F.col("header") == 0) | (F.col("p") + 1 < F.col("header")), "intro").otherwise("list")
    return rows.groupBy("doc_id", section.alias("section")).agg(F.count("*").alias("lines"))


@query("str09_steps_and_notes", r"""
WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), n AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT regexp_matches(x, '[*#$%&]{3}|!!')) AS kept FROM s)
SELECT doc_id, CAST(CASE WHEN len(kept) > 0 THEN len(kept) ELSE len(ls) END AS BIGINT) AS steps, len(kept) = 0 AS fell_back FROM n""")
def str09(spark, d):
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    kept = F.filter(ls, lambda x: ~x.rlike(r"[*#$%&]{3}|!!"))
    return docs(spark, d).select("doc_id", F.when(F.size(kept) > 0, F.size(kept)).otherwise(F.size(ls)).cast("long").alias("steps"), (F.size(kept) == 0).alias("fell_back"))


@query("str10_category", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|nut') THEN 'fastener' WHEN regexp_matches(p_name, '^red') THEN 'red' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'other' END AS category FROM part""")
def str10(spark, d):
    return table(spark, d, "part").select("p_partkey", T.first_match(F.col("p_name"), [("fastener", "bolt|nut"), ("red", "^red"), ("ring", "ring$")], "other").alias("category"))


@query("str11_directions", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[*#$%&]{3}') THEN 'noise' WHEN regexp_matches(text, '^[A-Z0-9 ,.!]+$') THEN 'shouting' WHEN contains(text, '|') THEN 'list'
  WHEN regexp_matches(text, '^\S+$') THEN 'word' WHEN len(regexp_extract_all(text, '\.')) >= 20 THEN 'long_prose' ELSE 'prose' END AS class FROM documents""")
def str11(spark, d):
    t = F.col("text")
    kind = F.when(t.rlike(r"[*#$%&]{3}"), "noise").when(t.rlike(r"^[A-Z0-9 ,.!]+\z"), "shouting").when(t.contains("|"), "list").when(t.rlike(r"^\S+\z"), "word")
    return docs(spark, d).select("doc_id", kind.when(F.regexp_count("text", F.lit(r"\.")) >= 20, "long_prose").otherwise("prose").alias("class"))


@query("str12_error_buckets", """
SELECT event_id, CASE WHEN regexp_matches(event_type, 'err') THEN 'failure' WHEN regexp_matches(event_type, '^(click|view)$') THEN 'browse' ELSE 'other' END AS bucket FROM events""")
def str12(spark, d):
    return table(spark, d, "events").select("event_id", T.first_match(F.col("event_type"), [("failure", "err"), ("browse", "^(click|view)$")], "other").alias("bucket"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB's \b knows words of ASCII only: there, letters of other alphabets stand between two ``_`` while it looks for whole words.
_OTHER = r"([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}])"


def _worded(text: str) -> str:
    return rf"regexp_replace({text}, '{_OTHER}', '_\1_', 'g')"


_SCRUB = "coalesce(line, '')"
for _pattern, _mark in T.MARKS:
    _SCRUB = f"regexp_replace({_worded(_SCRUB)}, {_quoted(_pattern)}, {_quoted(_mark)}, 'g')" if r"\b" in _pattern else f"regexp_replace({_SCRUB}, {_quoted(_pattern)}, {_quoted(_mark)}, 'g')"
    if r"\b" in _pattern:
        _SCRUB = rf"regexp_replace({_SCRUB}, '_{_OTHER}_', '\1', 'g')"


@query("str13_scrubbed", "WITH " + L + ", x AS (SELECT id, line FROM l UNION ALL SELECT -1 - doc_id, text FROM documents) SELECT id, substring(" + _SCRUB + ", 1, 500) AS t FROM x")
def str13(spark, d):
    rows = lines(spark, d).union(docs(spark, d).select(-1 - F.col("doc_id"), "text"))
    return rows.select("id", T.scrubbed(F.col("line")).alias("t"))


@query("str14_minimal_urls", r"""
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS minimal, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^www\.', ''), '/+$', '')) AS key FROM pages""")
def str14(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_minimal(F.col("url")).alias("minimal"), T.url_key(F.col("url")).alias("key"))


@query("str15_host_labels", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, url FROM pages)
SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'research' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'trade'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND contains(url, '/en/') THEN 'official' ELSE 'unclassified' END AS label FROM h""")
def str15(spark, d):
    host = T.url_host(F.col("url"))
    label = F.when(T.within_domain(host, "example.org"), "research").when(T.within_domain(host, "example.net"), "trade")
    return table(spark, d, "pages").select("page_id", label.when(T.within_domain(host, "example.com") & F.col("url").contains("/en/"), "official").otherwise("unclassified").alias("label"))


@query("str16_durations_and_yields", "WITH " + L + r""" SELECT id, nullif(regexp_extract(line, '([0-9]+) ?(?:-|to) ?([0-9]+) minutes', 2), '') AS longest,
  nullif(regexp_extract(line, '(?i)serves ([0-9]+)', 1), '') AS serves, CASE WHEN regexp_matches(line, '(?i)makes [0-9]+ dozen') THEN 12 * CAST(regexp_extract(line, '(?i)makes ([0-9]+) dozen', 1) AS BIGINT) END AS pieces,
  nullif(regexp_extract(line, '([0-9]{2,3})°[FC]', 1), '') AS temperature FROM l""")
def str16(spark, d):
    x = lambda pattern, i=1: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    return lines(spark, d).select(
        "id", x(r"([0-9]+) ?(?:-|to) ?([0-9]+) minutes", 2).alias("longest"), x(r"(?i)serves ([0-9]+)").alias("serves"),
        (x(r"(?i)makes ([0-9]+) dozen").cast("long") * 12).alias("pieces"), x(r"([0-9]{2,3})°[FC]").alias("temperature"))


@query("str17_several_records", r"SELECT doc_id, len(regexp_extract_all(text, '\n[A-Z]')) >= 2 AS several FROM documents")
def str17(spark, d):
    return docs(spark, d).select("doc_id", (F.regexp_count("text", F.lit(r"\n[A-Z]")) >= 2).alias("several"))


@query("str18_plural_words", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents) SELECT doc_id, list_has_any(ws, ['thing', 'things', 'thinges']) AS thing FROM w""")
def str18(spark, d):
    return docs(spark, d).select("doc_id", T.says_word(T.tokens(F.col("text")), "thing").alias("thing"))


@query("str19_phrase_plural", r"SELECT doc_id, regexp_matches(lower(text), '\bof the(?:s|es)?\b') AS hit FROM documents")
def str19(spark, d):
    return docs(spark, d).select("doc_id", F.lower("text").rlike(G.phrase_pattern("of the")).alias("hit"))


@query("str20_content_words", """
WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 3 AND NOT list_contains(['that', 'this', 'with', 'from'], x)) AS ws FROM conversations)
SELECT a.conv_id, a.turn, len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) = 0 AS subset FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def str20(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", G.content_words(F.col("text")).alias("ws"))
    b = w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("ws").alias("before"))
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.size(F.array_except("ws", "before")) == 0).alias("subset"))


@query("str21_negated_mentions", f"""
WITH c AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?;:]')) AS clause FROM documents), p AS (SELECT doc_id, string_split_regex(clause, '\\bthe\\b') AS parts FROM c),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(parts)), lambda i: list_filter(string_split_regex(array_to_string(parts[1:i], 'the'), '\\s+'), lambda w: w <> ''))) AS before FROM p),
m AS (SELECT doc_id, bool_and(regexp_matches(array_to_string(before[greatest(1, len(before) - 7):], ' '), {_quoted(G.NEGATION)})) AS negated FROM b GROUP BY 1)
SELECT doc_id, coalesce(negated, false) AS negated FROM documents LEFT JOIN m USING (doc_id)""")
def str21(spark, d):
    return docs(spark, d).select("doc_id", G.negated(F.col("text"), "the").alias("negated"))


_VOCABULARY = ["olive oil", "oil", "flour", "milk", "eggs", "egg", "the and", "the", "red ring", "ring"]
_TERMS_SQL = "SELECT id, lower(line) AS t0, ARRAY[]::VARCHAR[] AS f0 FROM x"
for _n, _term in enumerate(sorted(set(_VOCABULARY), key=lambda t: (-len(t), t))):
    _TERMS_SQL = (
        f"SELECT id, regexp_replace(t{_n}, '\\b{_term}\\b', '{' ' * len(_term)}') AS t{_n + 1}, CASE WHEN regexp_matches(t{_n}, '\\b{_term}\\b') THEN list_append(f{_n}, '{_term}') ELSE f{_n} END AS f{_n + 1} "
        f"FROM ({_TERMS_SQL})"
    )


@query("str22_vocabulary_terms", "WITH " + L + f", x AS (SELECT id, line FROM l UNION ALL SELECT -1 - doc_id, text FROM documents) SELECT id, list_sort(f{len(_VOCABULARY)}) AS terms FROM ({_TERMS_SQL})")
def str22(spark, d):
    rows = lines(spark, d).union(docs(spark, d).select(-1 - F.col("doc_id"), "text"))
    named = sorted(_VOCABULARY)
    index = H.PhraseIndex.build(spark.createDataFrame(list(enumerate(named)), "phrase_id long, phrase string"))
    found = H.longest_mentions(rows, index, ["id"], "line")
    return found.select("id", F.transform("phrase_ids", lambda k: F.element_at(F.array(*map(F.lit, named)), (k + 1).cast("int"))).alias("terms"))


@query("str23_time_claims", "WITH " + L + r""", s(v) AS (VALUES ('25-30 minutes'), ('350°F')), c AS (SELECT id, unnest(regexp_extract_all(line, '[0-9]+(?:-[0-9]+)? ?(?:minutes|hour|°[FC])')) AS claim FROM l)
SELECT id, claim, claim IN (SELECT v FROM s) AS supported FROM c""")
def str23(spark, d):
    c = lines(spark, d).select("id", F.explode(F.regexp_extract_all("line", F.lit(r"[0-9]+(?:-[0-9]+)? ?(?:minutes|hour|°[FC])"), F.lit(0))).alias("claim"))
    return c.withColumn("supported", F.col("claim").isin("25-30 minutes", "350°F"))


@query("str24_imperative_guard", "WITH " + L + r""" SELECT id, regexp_matches(line, '(?i)^(?:bake|cook|mix|add|stir)\b') AS imperative, CAST(len(regexp_extract_all(line, '[0-9]+')) AS BIGINT) AS numbers FROM l""")
def str24(spark, d):
    return lines(spark, d).select("id", F.col("line").rlike(r"(?i)^(?:bake|cook|mix|add|stir)\b").alias("imperative"), F.regexp_count("line", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("str25_token_estimates", "SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS estimated, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS reserved FROM documents")
def str25(spark, d):
    return docs(spark, d).select("doc_id", T.estimated_tokens(F.col("text")).alias("estimated"), T.reserved_tokens(F.col("text")).alias("reserved"))


@query("str26_identities", "SELECT doc_id, sha256(source || chr(31) || doc_id || chr(31) || 'r1' || chr(31) || text) AS identity FROM documents")
def str26(spark, d):
    from ..operators.aggregate import content_hash

    return docs(spark, d).select("doc_id", content_hash(F.col("source"), F.col("doc_id").cast("string"), F.lit("r1"), F.col("text")).alias("identity"))


@query("str27_embedding_text", "SELECT doc_id, substring(concat_ws(chr(10), source, lang, text), 1, 7000) AS chunk FROM documents")
def str27(spark, d):
    return docs(spark, d).select("doc_id", F.substring(F.concat_ws("\n", "source", "lang", "text"), 1, 7000).alias("chunk"))


@query("str28_privacy_scan", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {_quoted(T.EMAIL)})) AS BIGINT) AS emails, CAST(len(regexp_extract_all({_worded('text')}, {_quoted(T.PHONE)})) AS BIGINT) AS phones FROM documents
WHERE regexp_matches(text, '@|[0-9]{{3}}')""")
def str28(spark, d):
    count = lambda pattern: F.regexp_count("text", F.lit(T.whole_words(pattern))).cast("long")
    return docs(spark, d).filter(F.col("text").rlike("@|[0-9]{3}")).select("doc_id", count(T.EMAIL).alias("emails"), count(T.PHONE).alias("phones"))


@query("str29_fidelity_claims", """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), true), (2, false), (3, true), (4, false), (5, NULL)) v(id, claims) UNION ALL SELECT p_partkey + 100, p_partkey % 4 IN (0, 2) FROM part""")
def str29(spark, d):
    rows = [(1, "this is exactly the original recipe"), (2, "this is not exactly the original"), (3, "it follows the source faithfully"), (4, "follow these steps"), (5, None)]
    said = """CASE p_partkey % 4 WHEN 0 THEN concat('made exactly as ', p_name) WHEN 1 THEN concat('not exactly a ', p_name) WHEN 2 THEN concat(p_name, ', but unchanged') ELSE p_name END"""
    parts = table(spark, d, "part").select((F.col("p_partkey") + 100).alias("id"), F.expr(said).alias("text"))
    return spark.createDataFrame(rows, "id long, text string").unionByName(parts).select("id", G.claims_fidelity("text").alias("claims"))


@query("str30_step_ranges", "WITH " + L + r""", r AS (SELECT id, unnest(regexp_extract_all(line, '[0-9]+(?:-[0-9]+)?')) AS part FROM l WHERE regexp_matches(line, '(?i)steps?'))
SELECT id, CAST(unnest(range(CAST(split_part(part, '-', 1) AS BIGINT), CAST(split_part(part, '-', -1) AS BIGINT) + 1)) AS BIGINT) AS step FROM r""")
def str30(spark, d):
    return lines(spark, d).filter(F.col("line").rlike("(?i)steps?")).select("id", F.explode(G.step_numbers(F.col("line"))).alias("step"))


@query("vec11_suggestions")
def vec11(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return G.suggestions(names, [(1, "red bolts"), (2, "widgt"), (3, "zzz"), (4, "ring"), (5, "a very large bolt")])


#: Terms as users type them: names with a letter less, one changed, in the plural, or as one word.
_TYPED = """CASE p_partkey % 5 WHEN 0 THEN concat(substring(p_name, 1, 3), substring(p_name, 5, 100)) WHEN 1 THEN replace(p_name, 'e', 'a') WHEN 2 THEN concat(p_name, 's')
  WHEN 3 THEN replace(p_name, ' ', '') ELSE substring(p_name, 1, 4) END"""


@query("vec11_suggestions_table")
def vec11_table(spark, d):
    """Suggestions for every typed form of every part's name; difflib's ratio has no SQL."""
    parts = table(spark, d, "part")
    return S.suggestions(parts.select(F.col("p_name").alias("name")), parts.select(F.expr(_TYPED).alias("term")))


@query("vec11_containing", f"""
WITH n AS (SELECT DISTINCT p_name AS name, {_TYPED} AS term FROM part), a AS (SELECT DISTINCT name FROM n), b AS (SELECT DISTINCT term FROM n)
SELECT term, count(*) AS names FROM a JOIN b ON contains(name, term) GROUP BY term""")
def vec11_containing(spark, d):
    parts = table(spark, d, "part")
    found = S.containing(parts.select(F.expr(_TYPED).alias("inner")).distinct(), parts.select(F.col("p_name").alias("outer")).distinct())
    return found.groupBy(F.col("inner").alias("term")).agg(F.count("*").alias("names"))


@query("srt12_bounded_json", r"""
WITH t AS (SELECT doc_id, lang, n_chars, source, regexp_replace(text, '[^ !#-\[\]-~]', '?', 'g') AS x FROM documents),
j AS (SELECT *, '{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source || '", "text": "' || x || '"}' AS whole FROM t)
SELECT doc_id, CASE WHEN length(whole) <= 300 THEN whole ELSE '{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source || '", "_truncated": 1}' END AS json FROM j""")
def srt12(spark, d):
    x = F.regexp_replace("text", r"[^ !#-\[\]-~]", "?")
    fields = {"lang": F.col("lang"), "n_chars": F.col("n_chars"), "source": F.col("source"), "text": x}
    return docs(spark, d).select("doc_id", B.bounded_object(fields, 300).alias("json"))


@query("srt12_bounded_items", f"""
WITH {RECIPES_SQL}, n AS (SELECT source_id, unnest(names) AS name, generate_subscripts(names, 1) AS i, len(names) AS total FROM recipes),
e AS (SELECT *, sum(length(name) + 4) OVER (PARTITION BY source_id ORDER BY i) AS upto FROM n)
SELECT source_id, '[' || coalesce(string_agg('"' || name || '"', ', ' ORDER BY i) FILTER (upto <= 50), '') || ']' AS json, CAST(count(*) FILTER (upto > 50) AS INTEGER) AS dropped FROM e GROUP BY source_id""")
def srt12b(spark, d):
    return recipes(spark, d).select("source_id", B.bounded_items(F.col("names"), 50).alias("b")).select("source_id", "b.json", "b.dropped")
