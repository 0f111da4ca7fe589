"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself: punctuation (fragments without an end mark, lines full of
symbols), navigation (menus, breadcrumbs, tables of links) and boilerplate (notices that sites
repeat). Lines that fail are removed; a text that loses more than MAX_LOST of its words is rejected.
A text that fails the base rules is rejected in any case.

Everything happens within a row: no shuffle, no Python. Repeated three-word windows are found by
sorting a text's windows and comparing neighbours.

A null text has no words; texts without words fail the base rules. Repeated rows are judged alike; an
empty table gives an empty result. `judge` keeps the columns of its input except those that bear a
result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a text's words that removed lines may hold.
MAX_LOST = 0.5
#: A line without an end mark needs this many words; symbols a word that a line may have.
FRAGMENT_WORDS, SYMBOLS_A_WORD = 4, 0.5
SPACES = " \t\n\x0b\f\r"
SYMBOL = "[#*$%&|<>]"
END_MARKS = [*".!?…:;,\"'”’»)]}。！？"]
MENU = r"[|»›•→]"
MENU_MARKS = 3
#: Lower-case phrases of notices, by language; a line that holds one and has few words is boilerplate.
NOTICES = {
    "en": ("all rights reserved", "cookie policy", "accept cookies", "we use cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
           "javascript is disabled", "subscribe to our newsletter", "sign up for our", "log in to", "skip to content", "back to top", "share on facebook", "follow us on",
           "click here to", "powered by wordpress", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "cookies akzeptieren", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren",
           "javascript aktivieren", "zum inhalt springen", "nach oben", "folgen sie uns", "jetzt anmelden"),
    "fr": ("tous droits réservés", "accepter les cookies", "nous utilisons des cookies", "politique de confidentialité", "conditions d'utilisation", "mentions légales",
           "activer javascript", "aller au contenu", "haut de page", "suivez-nous", "abonnez-vous à"),
    "es": ("todos los derechos reservados", "aceptar cookies", "utilizamos cookies", "política de privacidad", "condiciones de uso", "aviso legal", "habilitar javascript",
           "saltar al contenido", "volver arriba", "síguenos en", "suscríbete a"),
}
NOTICE_WORDS = 40


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _pairs(a: Column) -> Column:
    """Neighbours of an array, as structs of fields 0 and 1."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.arrays_zip(F.slice(a, 1, n).alias("x"), F.slice(a, 2, n).alias("y"))


def line_fails(line: Column, notices: Column) -> Column:
    """A line with a word breaks the punctuation, navigation or boilerplate rule."""
    bare = F.btrim(line, F.lit(SPACES))
    n_words = F.regexp_count(bare, F.lit(WORD))
    fragment = ~F.substring(bare, -1, 1).isin(END_MARKS) & (n_words < FRAGMENT_WORDS)
    noisy = F.regexp_count(bare, F.lit(SYMBOL)) > n_words * SYMBOLS_A_WORD
    menu = F.regexp_count(bare, F.lit(MENU)) >= MENU_MARKS
    return fragment | noisy | menu | (notices & _has_notice(bare) & (n_words <= NOTICE_WORDS))


def _has_notice(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for phrases in NOTICES.values():
        for phrase in phrases:
            found = found | low.contains(phrase)
    return found


def judge(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_failed_lines, lost_words, clean_text (the lines that pass, repeated and blank ones included) and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_words", "clean_text", "kept"]
    # the input's other columns travel in one struct, so that their names cannot meet those used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("row")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cut = docs.select(row, words_of(F.col(f"`{text}`")).alias("words"), F.split(body, "\n", -1).alias("lines"), _has_notice(body).alias("notices"), F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    w, n = F.col("words"), F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("at"))
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    told = F.transform("lines", lambda x: F.struct(x.alias("line"), F.when(has_word(x), line_fails(x, F.col("notices"))).otherwise(F.lit(False)).alias("bad")))
    step = cut.select("row", "words", "n_symbols", F.filter("lines", has_word).alias("lines"), told.alias("told"), F.sort_array(windows).alias("windows"))
    same = lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"])
    twice = F.filter(_pairs(F.col("windows")), same)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["x"]["at"], p["y"]["at"])))))
    step = step.select("row", "words", "n_symbols", "lines", "told", places.alias("places"), F.filter("told", lambda x: x["bad"])["line"].alias("bad"))
    covered = F.aggregate(F.transform(_pairs(F.col("places")), lambda p: F.least(p["y"] - p["x"], F.lit(3))), F.lit(3), lambda s, x: s + x)
    counted = step.select(
        "row", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") == 0, F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size("bad").cast("long").alias("n_failed_lines"),
        F.regexp_count(F.array_join("bad", "\n"), F.lit(WORD)).cast("long").alias("lost_words"),
        F.array_join(F.filter("told", lambda x: ~x["bad"])["line"], "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words"))).select("row.*", *made)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts, and the SHA-256 of each cleaned text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words", clean)


_NOTICE_SQL = "|".join(phrase.replace("'", "''") for phrases in NOTICES.values() for phrase in phrases)
ORACLE = (r"""
with w as materialized (
  select row_number() over () as rn, doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         string_split(coalesce(text, ''), chr(10)) as all_lines,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select w.rn, t.i as pos, [words[t.i], words[t.i + 1], words[t.i + 2]] as three
  from w, unnest(range(1, len(words) - 1)) t(i)),
twice as (
  select rn, pos - lag(pos, 1, -9) over (partition by rn order by pos) as gap
  from (select rn, pos, count(*) over (partition by rn, three) as n from windows) where n > 1),
repeats as (select rn, sum(least(gap, 3)) as n_repeat_words from twice group by rn),
judged as (
  select doc_id, rn, words, body, lines, all_lines, list_transform(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]') and (
      (not list_contains(['.','!','?','…',':',';',',','"','''','”','’','»',')',']','}','。','！','？'], right(trim(x, E' \t\n\x0b\f\r'), 1)) and len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 4)
      or len(regexp_extract_all(x, '[#*$%&|<>]')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 0.5
      or len(regexp_extract_all(x, '[|»›•→]')) >= 3
      or (regexp_matches(lower(x), '@NOTICES@')
          and len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 40))) as fails
  from w),
parted as (
  select *, list_filter(all_lines, lambda x, i: fails[i]) as bad, array_to_string(list_filter(all_lines, lambda x, i: not fails[i]), chr(10)) as clean from judged),
counted as (
  select doc_id, len(words)::bigint as n_words, list_sum(list_transform(words, lambda x: len(x)))::bigint as word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, len(bad)::bigint as n_failed_lines,
         len(regexp_extract_all(array_to_string(bad, chr(10)), '[^\x20\x09-\x0D]+'))::bigint as lost_words, sha256(clean) as clean_sha256
  from parted left join repeats using (rn))
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_words <= 0.5 * n_words as kept,
       n_lines, n_failed_lines, lost_words, clean_sha256
from counted
""").replace("@NOTICES@", _NOTICE_SQL)
