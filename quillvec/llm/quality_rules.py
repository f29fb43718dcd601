"""Line-first quality rules, in DataFrame functions only.

Every line is held against punctuation, navigation, boilerplate, symbol, case
and repetition rules.  Lines that fail one go; a document that loses more than
`max_lost` of its words with them is rejected, as is one that fails the base
checks (too few words, or most of them in repeated three-word windows).

Everything happens within a row: there is no shuffle, and a document's lines are
never spread out.  Null and empty texts have no words and fail the base checks;
texts of any length are judged whole, and shares that are exactly at a limit pass.
Repeated rows each get the same verdict; an empty table gives no rows; other
columns of the input are ignored.

A line is to end like a sentence, with a mark of any script listed; a document's
last line may be cut off if it has `CUT_OFF` words.  Boilerplate is looked for in lines
of at most `SHORT` words, in English, German, French and Spanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import SPACE, bind, text_or_empty, whole_row, words

SYMBOLS = "#*$%&|<>"
#: Marks between the entries of menus and breadcrumbs.
SEPARATORS = "|»›•·"
MARKS = "#*$%&<>~^="
#: Last characters of lines that are sentences, with what may close after them.
ENDS = ".!?…:;\"')]”’»。！？؟۔।"
CUT_OFF, SHORT = 6, 40
#: Phrases, in small letters, of notices and controls.
PHRASES = {
    "en": "all rights reserved|cookie policy|accept (all )?cookies|enable javascript|privacy policy|terms of (use|service)|lorem ipsum|click here|sign up now|subscribe to our|share this (page|post|article)|skip to (main )?content|back to top",
    "de": "alle rechte vorbehalten|cookie-richtlinie|cookies akzeptieren|javascript aktivieren|aktivieren sie javascript|datenschutzerklärung|allgemeine geschäftsbedingungen|nutzungsbedingungen|hier klicken|klicken sie hier|jetzt anmelden|newsletter abonnieren|zum inhalt springen|nach oben scrollen",
    "fr": "tous droits réservés|politique de (confidentialité|cookies)|accepter (tous )?les cookies|activer javascript|activez javascript|conditions générales|conditions d.utilisation|mentions légales|cliquez ici|inscrivez-vous maintenant|abonnez-vous à|partager (cette page|cet article)|aller au contenu|haut de page",
    "es": "todos los derechos reservados|política de (privacidad|cookies)|aceptar (todas )?las cookies|aceptar cookies|activar javascript|habilitar javascript|términos (de uso|y condiciones)|aviso legal|haga clic aquí|haz clic aquí|regístrate ahora|suscríbete a|compartir (esta página|este artículo)|saltar al contenido|volver arriba",
}
BOILERPLATE = r"\b(" + "|".join(PHRASES.values()) + ")"


def count_of(text: Column, characters: str) -> Column:
    """How many of `characters` are in `text`."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(found: Column) -> Column:
    """How many of the words lie in three-word windows found twice or more among them."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        dup = F.filter(pairs, lambda x, k: same(F.get(pairs, k - 1), x) | same(F.get(pairs, k + 1), x))
        return bind(F.sort_array(F.transform(dup, lambda x: x["k"])), covered)

    def windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(pairs, twice))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)))

    return bind(found, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(hashed(w), windows)))


def line_fails(line: Column, found: Column, last: Column) -> Column:
    """Whether `line`, whose words are `found` (one at least), breaks a rule; `last`: it is its document's last."""
    n = F.size(found)
    separators = count_of(line, SEPARATORS)
    unended = (F.instr(F.lit(ENDS), F.right(F.rtrim(line), F.lit(1))) == 0) & ~(last & (n >= CUT_OFF))
    navigation = (separators >= 3) & (5 * separators >= n)
    marked = 2 * count_of(line, MARKS) >= n
    shouted = (n >= 5) & ~line.rlike("[a-z]") & (F.upper(line) == line) & (F.lower(line) != line)
    repetitive = (n >= 10) & (4 * F.size(F.array_distinct(found)) <= n)
    boilerplate = (n <= SHORT) & F.lower(line).rlike(BOILERPLATE)
    return unended | navigation | marked | shouted | boilerplate | repetitive


def verdicts(lines: Column, found: Column) -> Column:
    """For each line the number of its words, and whether it fails; `found`: the words of each."""
    return F.transform(lines, lambda line, k: bind(F.get(found, k), lambda w: F.struct(F.size(w).alias("n"), line_fails(line, w, k == F.size(lines) - 1).alias("fails"))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.3) -> DataFrame:
    """One row a document: the base counts, `base_failed`, `kept`, and what the line rules removed."""
    percent = round(100 * max_lost)
    row = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    row = row.select(id_col, "_t", lines.alias("_l")).select(id_col, "_t", "_l", F.transform("_l", words).alias("_w"))
    row = row.select(id_col, "_t", "_l", F.flatten("_w").alias("_words"), F.filter(verdicts(F.col("_l"), F.col("_w")), lambda v: v["fails"]).alias("_gone"))
    row = row.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.struct(F.size("_gone").alias("n"), F.aggregate("_gone", F.lit(0), lambda a, x: a + x["n"]).alias("words")).alias("_lost"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return row.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * F.col("_lost.words") <= percent * F.col("n_words"))).alias("kept"),
        F.col("_lost.n").cast("long").alias("lines_removed"), F.col("_lost.words").cast("long").alias("words_removed"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.3) -> DataFrame:
    """The documents that are kept, without the lines that fail; other columns stay as they are."""
    every = F.split(text_or_empty(F.col(text_col)), "\n")
    row = docs.select(whole_row(docs), every.alias("every"), F.filter(every, lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    row = row.withColumn("words", F.transform("lines", words)).withColumn("verdicts", verdicts(F.col("lines"), F.col("words")))
    # a line of `every` is the next of `lines` if it has a word; its number there is how many worded lines come before it
    marked = F.aggregate(
        "every", F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("left")),
        lambda a, x: F.when(~x.rlike(f"[^{SPACE}]"), F.struct(a["k"].alias("k"), F.array_append(a["left"], x).alias("left"))).otherwise(
            F.struct((a["k"] + 1).alias("k"), F.when(F.get("verdicts", a["k"])["fails"], a["left"]).otherwise(F.array_append(a["left"], x)).alias("left"))
        ),
        lambda a: a["left"],
    )
    kept = F.aggregate("verdicts", F.lit(0), lambda a, v: a + F.when(v["fails"], 0).otherwise(v["n"]))
    row = row.select("doc", marked.alias("left"), F.size(F.flatten("words")).alias("n"), repeated_words(F.flatten("words")).alias("repeated"), kept.alias("kept"))
    good = (F.col("n") >= 50) & (100 * F.col("repeated") <= 50 * F.col("n")) & (100 * (F.col("n") - F.col("kept")) <= round(100 * max_lost) * F.col("n"))
    return row.where(good).select(F.col("doc").withField(text_col, F.array_join("left", "\n")).alias("doc")).select("doc.*")
