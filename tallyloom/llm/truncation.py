"""Texts cut off by field limits or transfers, found by word trigrams inside texts and at their ends, in pure SQL.

A trigram at the end of a text that is frequent inside texts but almost never ends one shows a cut. Texts of one source
are compared with each other, since a sentence that ends a note doesn't end a log line. Where the final trigram itself
is too rare to judge (names, numbers, half words), words give way to their shape, one after the other, and the most
specific forms with enough support decide; and a final word that hardly ever follows its two predecessors, while few
others do, is a half word. What is enough is measured by the texts themselves: a form is judged if it occurs in as many
places as SUPPORT texts have words on average, so small and large sources, and small and large corpora, are held to the
same standard. Endings at a source's field limits are no evidence of a regular ending, so texts of a length that occurs
far more often than its neighbours are left out of the counts of ends; and as most of them are cut, less is asked of them:
their form must end texts no more often than trigrams do on average, with a fifth of the support.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import staged, table

SUPPORT, AT_LIMIT = 2.5, 0.5  # texts' worth of words in which a form must occur to decide, and for texts at a limit
ENDS_AT_MOST = 0.004  # share of its occurrences at ends, one apart, up to which a form shows a cut
CONTEXT = 300  # occurrences of two words that tell which words follow them
COMMON, CLOSED = 0.01, 0.9  # few words can follow two others if followers of this share make up so much of all
STRANGE = 0.002  # share of the occurrences of its predecessors below which a follower is a half word
SPIKE, SPIKE_LEAST, SPIKE_NEAR = 5, 4, 25  # a limit: so many times its neighbours' mean, so many texts, so near
SALTS = 16  # tasks over which a form or an ending of very many texts is dealt
# What exports leave behind a break, and white space.
MARKS = r"(\.\.\.|…|\ufffd+|\\(?:u[0-9a-fA-F]{0,3})?|\[truncated\]|\[\.\.\.\]|\[…\]|\(more\)|\(truncated\)|\(continued\)|&#?[A-Za-z0-9]{0,5}|<truncated>)$"
BLANKS = " \t\n\r\f\u000b\u0085\u00a0\u2028\u2029\u3000\ufeff\u200b"
HEX, NUMBER = r"\b0x[0-9A-Fa-f]++", r"[0-9]++(?:[.][0-9]++)*+"
HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
# A token: a word with its hyphened parts, a number (0) with its letters, a line or cell end, a sign. Ideographs and kana
# are words of their own and are set apart before.
TOKEN = r"(?:[a-zA-Z_]++|[\p{L}\p{M}]++)(?:[a-zA-Z0_]++|-|[\p{L}\p{M}]++)*+|0(?:[a-zA-Z0_]++|-|\p{L}++)*+|[\n\t]|\S"
WORD = r"^[\p{L}\p{M}_]"
PATTERNS = {"marks": MARKS, "blanks": BLANKS, "hex": HEX, "number": NUMBER, "token": TOKEN, "word": WORD, "han": HAN}

# Forms of a trigram from the most to the least specific: among whose texts it is counted (its source's or all), and
# which of its words are kept; the others become their shapes. What precedes the last word says more about a cut than
# the last word itself, so forms that keep it come first. The last two, without words or shapes, count all trigrams.
FORMS = [(among, form) for among, forms in (("source", "111 110"), ("0", "111 110"), ("source", "011 101 100 010"), ("0", "011 101 100 010"), ("source", "001 000"), ("source", "___"), ("0", "___")) for form in forms.split()]
BASE = {among: FORMS.index((among, "___")) for among in ("source", "0")}


def _words(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(source, digest, n_chars, n_bytes, words): each distinct text of a source once, without what follows its end.

    A word is the hash of its spelling, whose last two bits are its shape: 1 for words, 2 for numbers; a sign, 0, is its
    own shape. The source is hashed as well, so all that is counted later has a fixed width."""
    return spark.sql(
        """
        WITH kept AS (SELECT xxhash64(source) AS source, unhex(md5(text)) AS digest, length(text) AS n_chars, octet_length(text) AS n_bytes, any_value(trim(TRAILING :blanks FROM text)) AS body
            FROM {texts} WHERE trim(BOTH :blanks FROM text) <> '' GROUP BY ALL),
        marked AS (SELECT *, length(regexp_extract(right(body, 16), :marks, 0)) AS mark FROM kept),
        ended AS (SELECT source, digest, n_chars, n_bytes, CASE WHEN mark > 0 THEN trim(TRAILING :blanks FROM left(body, length(body) - mark)) ELSE body END AS body FROM marked),
        bare AS (SELECT source, digest, n_chars, n_bytes, regexp_replace(CASE WHEN contains(body, '0x') THEN regexp_replace(body, :hex, '0') ELSE body END, :number, '0') AS body FROM ended),
        apart AS (SELECT source, digest, n_chars, n_bytes, CASE WHEN octet_length(body) > length(body) AND body RLIKE :han THEN regexp_replace(body, :han, ' $0 ') ELSE body END AS body FROM bare WHERE body <> '')
        SELECT source, digest, n_chars, n_bytes, transform(concat(array('^', '^'), regexp_extract_all(body, :token, 0)),
            w -> (xxhash64(w) & ~3L) | CASE WHEN startswith(w, '0') THEN 2L WHEN w < 'A' THEN 0L WHEN w < '[' OR (w >= '_' AND w < '`') OR (w >= 'a' AND w < '{{') THEN 1L WHEN w < '\\u0080' THEN 0L WHEN w RLIKE :word THEN 1L ELSE 0L END) AS words FROM apart""",
        args=PATTERNS, texts=texts,
    )


def _limits(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(source, unit, size): lengths at which far more texts of a source end than at those around them."""
    return spark.sql(
        f"""
        WITH sizes AS (SELECT source, unit, size, count(*) AS n FROM (SELECT source, inline(array(struct('chars' AS unit, n_chars AS size), struct('bytes' AS unit, n_bytes AS size))) FROM {{words}}) GROUP BY ALL),
        near AS (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN {SPIKE_NEAR} PRECEDING AND {SPIKE_NEAR} FOLLOWING) - n AS around FROM sizes)
        SELECT source, unit, size FROM near WHERE n >= {SPIKE_LEAST} AND n > {SPIKE} * around / {2 * SPIKE_NEAR}D""",
        words=words,
    )


def _form_key(among: str, form: str) -> str:
    kept = {"1": "{0}", "0": "CASE WHEN {0} & 3 > 0 THEN {0} & 3 ELSE {0} END", "_": "0"}
    return f"xxhash64({among}, '{form}', " + ", ".join(kept[keep].format(x) for x, keep in zip("abc", form)) + ")"


def _salts(form: str) -> str:
    """Over how many tasks a form is dealt: forms that keep no words but signs are few, and may be those of very many texts."""
    kept = [x for x, keep in zip("abc", form) if keep == "1"]
    return f"CASE WHEN {' AND '.join(f'{x} & 3 = 0' for x in kept)} THEN {SALTS} ELSE 1 END" if kept else str(SALTS)


def find_truncated(texts: DataFrame) -> DataFrame:
    """(digest, source): md5 digests of the texts of ``texts`` (source, text) that were cut off, and hashes of their sources.

    Null, empty and blank texts are never cut. Copies count once per source, and a null source is a source of its own.
    Trigrams are counted with map-side combining before they fan out into forms, as rows of a fixed width, and every
    join is by a form's key between tables with one row per key on one side; the final trigrams, at most one per distinct
    text, are never collected. On the other side a form that keeps few words, or an ending of very many texts, may be a
    hot key: these rows are dealt over SALTS tasks, to each of which the one row is copied. Too little support of every
    form of an ending, as in tables of a few texts, decides nothing: such texts count as whole.
    """
    spark = texts.sparkSession
    words = staged(_words(spark, texts), "p10-words")
    limits = staged(_limits(spark, words), "p10-limits")
    free = spark.sql(
        """
        SELECT w.source, w.digest, w.words, c.size IS NULL AND b.size IS NULL AS free FROM {words} w
        LEFT JOIN {limits} c ON c.source = w.source AND c.unit = 'chars' AND c.size = w.n_chars
        LEFT JOIN {limits} b ON b.source = w.source AND b.unit = 'bytes' AND b.size = w.n_bytes""",
        words=words, limits=limits,
    )
    trigrams = spark.sql(
        """
        WITH every AS (SELECT source, inline(arrays_zip(slice(words, 1, size(words) - 2), slice(words, 2, size(words) - 2), slice(words, 3, size(words) - 2))) AS (a, b, c) FROM {free}),
        placed AS (SELECT source, a, b, c, 1 AS n, 0 AS ends, 0 AS all_ends FROM every UNION ALL
            SELECT source, element_at(words, -3), element_at(words, -2), element_at(words, -1), 0, CAST(free AS INT), 1 FROM {free})
        SELECT source, a, b, c, sum(n) - sum(all_ends) AS inside, sum(ends) AS ends, sum(all_ends) AS all_ends FROM placed GROUP BY source, a, b, c""",
        free=free,
    )
    trigrams = staged(trigrams, "p10-trigrams")
    # The first form is the trigram itself, whose counts are at hand.
    fan = "inline(array(" + ", ".join(f"struct({level} AS level, {_form_key(*f)} AS k, {_salts(f[1])} AS salts)" for level, f in enumerate(FORMS) if level) + "))"
    counts = spark.sql(
        f"""SELECT k, n_inside, n_ends, explode(sequence(0, salts - 1)) AS salt FROM
        (SELECT k, salts, sum(inside) AS n_inside, sum(ends) AS n_ends FROM (SELECT inside, ends, {fan} FROM {{t}}) GROUP BY k, salts)""",
        t=trigrams,
    )
    context = "xxhash64(source, a, b)"
    followers = spark.sql(
        f"""
        WITH f AS (SELECT {context} AS k, inside + ends AS m FROM {{t}}), n AS (SELECT k, sum(m) AS n FROM f GROUP BY k HAVING sum(m) >= {CONTEXT})
        SELECT k, any_value(n) AS n, sum(CASE WHEN m >= {COMMON} * n THEN m ELSE 0 END) AS common FROM f JOIN n USING (k) GROUP BY k""",
        t=trigrams,
    )
    # A final trigram is judged without its own end, which is one of the ends if that text's length is free. A form is
    # judged if it has as many occurrences as SUPPORT texts among the same have words; bases are these texts' lengths.
    bases = ", ".join(f"max(CASE WHEN level = {level} THEN (n_inside + n_ends) / greatest(n_ends, 1) END) AS {'here' if among == 'source' else 'everywhere'}" for among, level in BASE.items())
    here = ", ".join(str(level) for level, (among, _) in enumerate(FORMS) if among == "source")
    decides = lambda support: f"array_min(filter(forms, f -> f.level < {min(BASE.values())} AND f.n >= {support} * CASE WHEN f.level IN ({here}) THEN here ELSE everywhere END))"
    judged = spark.sql(
        f"""
        WITH finals AS (SELECT source, a, b, c, inside, ends, {context} AS ctx, {fan} FROM {{t}} WHERE all_ends > 0),
        dealt AS (SELECT *, CAST(pmod(xxhash64(source, a, b, c), salts) AS INT) AS salt FROM finals),
        met AS (SELECT f.source, f.a, f.b, f.c, f.level, f.inside, f.ends, f.ctx, n.n_inside, n.n_ends FROM dealt f JOIN {{counts}} n ON n.k = f.k AND n.salt = f.salt
          UNION ALL SELECT source, a, b, c, 0, inside, ends, {context}, inside, ends FROM {{t}} WHERE all_ends > 0),
        forms AS (SELECT source, a, b, c, first(ctx) AS ctx, first(inside) AS inside, first(ends) AS ends, {bases},
            collect_list(struct(level, (greatest(n_ends - least(ends, 1), 0) - 1) / greatest(n_inside + n_ends, 1)::double AS share, n_inside + n_ends AS n, n_ends / greatest(n_inside + n_ends, 1)::double AS rate)) AS forms
          FROM met GROUP BY source, a, b, c),
        best AS (SELECT source, a, b, c, ctx, inside, ends, here, everywhere, {decides(SUPPORT)} AS decides, {decides(AT_LIMIT)} AS at_limit FROM forms),
        both AS (SELECT source, a, b, c, coalesce(decides.share <= {ENDS_AT_MOST}, false) OR coalesce(n.common >= {CLOSED} * n.n AND inside + greatest(ends - 1, 0) <= {STRANGE} * n.n, false) AS cut,
            coalesce(at_limit.rate * CASE WHEN at_limit.level IN ({here}) THEN here ELSE everywhere END <= 1, false) AS cut_at_limit
          FROM best LEFT JOIN {{followers}} n ON n.k = best.ctx)
        SELECT * FROM both WHERE cut OR cut_at_limit""",
        t=trigrams, counts=counts, followers=followers,
    )
    last = "element_at(words, -3) AS a, element_at(words, -2) AS b, element_at(words, -1) AS c"
    return spark.sql(
        f"""
        WITH e AS (SELECT source, digest, free, {last}, CAST(pmod(xxhash64(digest), {SALTS}) AS INT) AS salt FROM {{free}}),
        j AS (SELECT source, a, b, c, cut, cut_at_limit, explode(sequence(0, {SALTS - 1})) AS salt FROM {{judged}})
        SELECT e.digest, e.source FROM e JOIN j ON j.source = e.source AND j.a = e.a AND j.b = e.b AND j.c = e.c AND j.salt = e.salt WHERE j.cut OR (j.cut_at_limit AND NOT e.free)""",
        free=free, judged=judged,
    )


def truncated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = find_truncated(docs.select("source", "text")).select("digest").distinct()
    return spark.sql("SELECT d.doc_id, d.source FROM {docs} d LEFT SEMI JOIN {cut} c ON unhex(md5(d.text)) = c.digest", docs=docs, cut=cut)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_documents(spark, sf_dir).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated texts of each source among those that are not null or blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = truncated_documents(spark, sf_dir).select("doc_id")
    return spark.sql(
        f"""SELECT coalesce(d.source, '') AS source, count(*) AS n_texts, count(c.doc_id) AS n_truncated, round(count(c.doc_id) / count(*), 6) AS rate
        FROM {{docs}} d LEFT JOIN {{cut}} c ON c.doc_id = d.doc_id WHERE trim(BOTH :blanks FROM d.text) <> '' GROUP BY 1""",
        args=PATTERNS, docs=docs, cut=cut,
    )


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
ORACLES: dict[str, str] = {}
