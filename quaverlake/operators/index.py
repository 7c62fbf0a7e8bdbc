"""The inverted index over search documents: lookup terms by lane, postings with their statistics, and side tables.

A document has kind, id, title, artist, album, native_rating, artist_ids, year and genre_keys; its key is kind:id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metaphone import double_metaphone
from ..functions.numerals import cardinal_key

FIELDS = ["title", "artist", "album", "combined"]
KINDS = ["artist", "album", "track", "playlist"]
DOCUMENT = "kind string, id string, title string, artist string, album string, native_rating int, artist_ids array<string>, year int, genre_keys array<string>"


@dataclass(frozen=True)
class EquivalenceProvider:
    """An extension lane: `indexed` gives the keys of a field's text, `query` those of a span (struct of text and size, number and the whole query)."""

    name: str
    signal: str
    score: int
    indexed: Callable[[Column], Column]
    query: Callable[[Column, Column, Column], Column]


#: The two built-in lanes: spoken acronyms, and cardinals in any notation.
ACRONYM = EquivalenceProvider("acronym", "spoken_acronym", 1220, T.acronym_keys, lambda span, number, whole: F.array(T.compact(span)))
CARDINAL = EquivalenceProvider("roman_cardinal", "roman_cardinal_equivalent", 1200, lambda c: F.array_compact(F.array(cardinal_key(c))), lambda span, number, whole: F.array_compact(F.array(F.get(whole, number))))


def register_equivalence(providers: list[EquivalenceProvider], provider: EquivalenceProvider) -> list[EquivalenceProvider]:
    """The providers with one more; a name may be taken once."""
    if provider.name in [p.name for p in providers]:
        raise ValueError(f"lane {provider.name} is taken")
    return [*providers, provider]


def text_forms(c: Column, phonetic: bool = True, providers: list[EquivalenceProvider] | None = None) -> Column:
    """All forms of a text in one struct: normalised, compact, tokens, skeleton, trigrams, spoken (digits as words), double_metaphone, and the keys of every provider under its name. What the
    index, the lanes and the scores know of a provider they know from here."""
    providers = [ACRONYM, CARDINAL] if providers is None else providers
    base = T.text_forms(c)
    fields = [base[f].alias(f) for f in ("normalised", "compact", "tokens", "skeleton", "trigrams")]
    spoken = T.expand_digits(T.normalise(c))
    fields.append(spoken.alias("spoken"))
    if phonetic:
        fields.append(double_metaphone(spoken).alias("double_metaphone"))
    return F.struct(*fields, *[p.indexed(c).alias(p.name) for p in providers])


def stable_key() -> Column:
    return F.concat(F.col("kind"), F.lit(":"), F.col("id"))


def kind_order(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def field_rows(docs: DataFrame) -> DataFrame:
    """(key, field, text) of the fields that have text; combined is title, artist and album with a space between."""
    combined = F.concat_ws(" ", "title", "artist", "album")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) if f != "combined" else combined).alias("text")) for f in FIELDS]))
    return docs.select(stable_key().alias("key"), each.alias("f")).select("key", "f.*").where("text is not null")


def lookup_terms(docs: DataFrame, phonetic: bool = True, providers: list[EquivalenceProvider] | None = None) -> DataFrame:
    """Distinct (lane, term, key). Forms are made once for each distinct text."""
    providers = [ACRONYM, CARDINAL] if providers is None else providers
    rows = field_rows(docs)
    forms = rows.select("text").distinct().withColumn("f", text_forms(F.col("text"), phonetic, providers))
    lane = lambda name, terms: F.transform(terms, lambda t: F.struct(F.lit(name).alias("lane"), t.alias("term")))
    lanes = [lane(name, F.array(f"f.{name}")) for name in ("normalised", "compact", "skeleton")]
    lanes += [lane(name, F.col(f"f.{name}")) for name in (["double_metaphone"] if phonetic else []) + [p.name for p in providers]]
    terms = forms.select("text", F.explode(F.concat(*lanes)).alias("t")).select("text", "t.*").where("term <> ''")
    return rows.join(terms, "text").select("lane", "term", "key").distinct()


def _combined(docs: DataFrame) -> DataFrame:
    """(key, text) dealt by key: the texts are shuffled, once, and all that is counted by document stays where it is."""
    return docs.select(stable_key().alias("key"), F.concat_ws(" ", "title", "artist", "album").alias("text")).repartition("key")


def token_postings(docs: DataFrame) -> DataFrame:
    """(key, term, tf, length): words of the combined text and how many words it has."""
    return _postings(_combined(docs).select("key", T.tokens(T.normalise(F.col("text"))).alias("w")))


def trigram_postings(docs: DataFrame) -> DataFrame:
    return _postings(_combined(docs).select("key", T.all_trigrams(T.compact(T.normalise(F.col("text")))).alias("w")))


def _postings(words: DataFrame) -> DataFrame:
    each = words.select("key", F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
    return each.groupBy("key", "term", "length").agg(F.count("*").alias("tf")).select("key", "term", "tf", "length")


def document_artists(docs: DataFrame) -> DataFrame:
    return docs.select(stable_key().alias("key"), F.explode("artist_ids").alias("artist_id")).where("trim(artist_id) <> ''").distinct()


def document_genres(docs: DataFrame) -> DataFrame:
    return docs.select(stable_key().alias("key"), F.explode("genre_keys").alias("genre_key")).where("trim(genre_key) <> ''").distinct()
