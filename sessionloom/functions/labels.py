"""Column functions on labels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["clean_topic_name", "context_hint", "length_fallback", "match_bucket", "normalise_dedup", "normalise_memory", "normalise_plain", "preview", "resolve_label", "rule_domain", "summarise"]

#: Rewrites of a normalised label, applied in this order.
DEDUP_REWRITES = [("prenotazioni", "prenotazione"), ("referti", "ritiro_referti"), ("pagamenti", "fatturazione"), ("contatti", "orari_contatti"), ("informazioni", "info")]
#: Hints on a conversation's context; the first whose words occur counts.
HINTS = [
    ([["urgente", "emergenza", "subito", "aiuto"]], "Richiesta urgente - valuta priorità massima"),
    ([["non riesco", "non funziona", "errore", "sbagliato", "non entra", "non accede", "login", "password"], ["portale", "sito", "accesso", "login", "account"]], "Problema tecnico di accesso - priorità problema_accesso_portale su altre categorie"),
    ([["non capisco", "confuso", "sbagliato", "errore"]], "Utente confuso - semplifica classificazione verso problemi tecnici"),
    ([["grazie", "cortesia", "informazione", "sapere"]], "Richiesta informativa - preferisci etichette info_*"),
    ([["voglio", "devo", "prenotare", "ritirare", "cambiare"]], "Richiesta operativa - preferisci etichette di azione"),
]
#: What a label's words say of its domain; the first that occurs is added.
DOMAINS = {
    "accesso": "problemi di accesso al portale login password",
    "prenotazione": "prenotazione visite esami appuntamenti",
    "referti": "ritiro scarico referti risultati analisi",
    "fatturazione": "fatture pagamenti costi ricevute",
    "orari": "orari apertura contatti telefono informazioni",
    "problemi": "problemi tecnici errori malfunzionamenti",
}


def normalise_memory(label: Column) -> Column:
    """Lower case, white space as ``_``, only ``a-z0-9_``, no double or outer ``_``."""
    joined = F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_]", ""), "_+", "_"), F.lit("_"))


def normalise_plain(label: Column) -> Column:
    """Letters, digits and ``_`` of any language, white space as ``_``, lower case."""
    kept = F.regexp_replace(label, r"[^\p{L}\p{N}_\s]", "")
    return F.lower(F.regexp_replace(F.trim(kept), r"\s+", "_"))


def normalise_dedup(label: Column) -> Column:
    """As ``normalise_plain``, with the fixed rewrites."""
    out = normalise_plain(label)
    for old, new in DEDUP_REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_topic_name(name: Column) -> Column:
    """A topic's name without its number, as a label; ``sconosciuto`` where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\d+_", ""), "[^a-zA-Z0-9_]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.lower(F.trim(plain, F.lit("_"))), F.lit("")), F.lit("sconosciuto"))


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def summarise(text: Column, n: int = 300) -> Column:
    """Texts over ``n`` characters as their first and last sentence, or cut if that is too long."""
    parts = F.split(text, r"\.")
    last = F.when(F.trim(F.element_at(parts, -1)) != "", F.element_at(parts, -1)).otherwise(F.element_at(parts, -2))
    both = F.concat(F.element_at(parts, 1), F.lit(". [...] "), last)
    long = F.when(F.size(parts) <= 2, F.concat(F.left(text, F.lit(n)), F.lit("..."))).when(F.length(both) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(both)
    return F.when(F.length(text) <= n, text).otherwise(long)


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def context_hint(text: Column, hints: list[tuple[list[list[str]], str]] | None = None) -> Column:
    """The hint of the first rule of which each group of words has one in the text; null if none."""
    low, out = F.lower(text), None
    for groups, hint in hints or HINTS:
        holds = F.lit(True)
        for words in groups:
            holds = holds & _any(low, words)
        out = F.when(holds, hint) if out is None else out.when(holds, hint)
    return out


def rule_domain(label: Column, domains: dict[str, str] | None = None) -> Column:
    """A label as words, with what the first known word in it stands for."""
    words, out = F.replace(label, F.lit("_"), F.lit(" ")), None
    for key, context in (domains or DOMAINS).items():
        holds, text = F.lower(words).contains(key), F.concat(words, F.lit(" " + context))
        out = F.when(holds, text) if out is None else out.when(holds, text)
    return out.otherwise(words)


def match_bucket(similarity: Column) -> Column:
    """How well two labels match, in words."""
    return F.when(similarity >= 0.95, "exact").when(similarity >= 0.85, "high").when(similarity >= 0.7, "medium").when(similarity >= 0.5, "low").otherwise("none")


def length_fallback(text: Column) -> Column:
    """Confidence of a fallback label, by the length of the text alone."""
    n = F.length(F.trim(text))
    return F.when(n < 10, 0.05).when(n > 500, 0.15).otherwise(0.10)


def resolve_label(label: Column, known: list[str], corrections: dict[str, str], prefixes: dict[str, list[str]], fallback: str = "altro") -> Column:
    """A label in the vocabulary ``known``: itself, its correction, the nearest within two edits, or the only one of a keyword's prefix.

    The vocabulary is a parameter, so it has a bound. Of equally near labels
    the first in the vocabulary counts; lengths have to be within a ratio of .6.
    """
    near = F.lit(None).cast("struct<d:int,k:int,name:string>")
    options = [
        F.when(
            (F.levenshtein(label, F.lit(x), 2) >= 0) & (F.least(F.length(label), F.lit(len(x))) / F.greatest(F.length(label), F.lit(len(x))) >= 0.6),
            F.struct(F.levenshtein(label, F.lit(x)).alias("d"), F.lit(k).alias("k"), F.lit(x).alias("name")),
        )
        for k, x in enumerate(known)
        if x != fallback
    ]
    near = F.least(*options, F.lit(None).cast("struct<d:int,k:int,name:string>"))["name"] if options else F.lit(None).cast("string")
    fixed = F.create_map(*(F.lit(x) for pair in corrections.items() for x in pair))[label] if corrections else F.lit(None).cast("string")
    by_word, words = None, F.replace(label, F.lit("_"), F.lit(" "))
    for prefix, keys in prefixes.items():
        found = [x for x in known if x.startswith(prefix)]
        if len(found) == 1:
            by_word = F.when(_any(words, keys), found[0]) if by_word is None else by_word.when(_any(words, keys), found[0])
    guess = by_word if by_word is not None else F.lit(None).cast("string")
    return F.when(label.isin(known), label).otherwise(F.coalesce(fixed, near, guess, F.lit(fallback)))
