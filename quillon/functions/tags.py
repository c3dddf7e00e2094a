"""Word tags and entity names: one row per record, no shuffle; what would be a step for each word runs in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.batches import aligned_of, both_of, names_of, tagged, tags_of
from quillon.functions.text import let, strip

# Fixed values that must equal those of the formats produced.
LABELS = ("O", "B-ENFERMEDAD", "I-ENFERMEDAD")
SEPARATOR = " [SEP] "
NOTHING = "ninguna"
INSTRUCTION = "Identifica las enfermedades mencionadas en el siguiente texto clínico: "
IGNORED = -100


def placed(entities: Column) -> Column:
    """Entities with both offsets; null arrays are empty."""
    kind = "array<struct<start:int,end:int,text:string,label:string,normalized_term:string>>"
    return F.coalesce(F.filter(entities, lambda e: e["start"].isNotNull() & e["end"].isNotNull()), F.array().cast(kind))


def bio_tags(words: Column, entities: Column, name: str = "ENFERMEDAD") -> Column:
    """One tag per word: B for the first word an entity overlaps, I for its others, O elsewhere. Where entities meet
    on a word, the later in the array wins. The label of an entity does not matter. Null words have null tags;
    null entities and entities without offsets tag nothing. The words under an entity are found by binary search."""
    return F.arrow_udf(tags_of(name), "array<string>")(words, _bare(entities))


def tagged_words(text: Column | str, entities: Column | str, name: str = "ENFERMEDAD") -> Column:
    """struct<tokens:array<string>,tags:array<string>> of a text, tags as in bio_tags; both null for a null text."""
    entities = F.col(entities) if isinstance(entities, str) else entities
    return F.arrow_udf(tagged(name), "struct<tokens:array<string>,tags:array<string>>")(text, _bare(entities))


def _bare(entities: Column) -> Column:
    """Offsets only, so that nothing else is handed over."""
    return F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))


def entity_names(values: Column) -> Column:
    """Stripped lower-case names, each once, blanks and nulls left out, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: v.isNotNull() & (v != "")))


def bio_decode(tokens: Column, tags: Column) -> Column:
    """Names of the entities that tags mark in tokens, as entity_names leaves them. B opens one, I goes on with an open one,
    anything else closes; an I with nothing open marks nothing. Words are joined by one blank. The longer array is cut to
    the other; null where either is."""
    return F.arrow_udf(names_of, "array<string>")(tokens, tags)


def decoded_marks(tokens: Column | str, truth: Column | str, predicted: Column | str) -> Column:
    """array<struct<entity:string,t:boolean>>: names that either tags mark in tokens, as bio_decode finds them, and whether they
    are the true ones; empty where tokens or both tags are null."""
    return F.arrow_udf(both_of, "array<struct<entity:string,t:boolean>>")(tokens, truth, predicted)


def seq2seq_target(entities: Column) -> Column:
    """Normalised terms (else texts) in order, each once, joined by the separator; the sentinel where there is none."""
    terms = F.array_distinct(F.filter(F.transform(entities, lambda e: F.coalesce(e["normalized_term"], e["text"])), lambda t: t.isNotNull()))
    return let(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.when(F.size(t) == 0, NOTHING).otherwise(F.array_join(t, SEPARATOR)))


def seq2seq_input(text: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION), text)


def parse_generated(col: Column) -> Column:
    """Entity names in a generated answer; the sentinel in any case and with any blanks around it is none."""
    parts = entity_names(F.split(col, r"\[SEP\]"))
    return F.when(F.lower(strip(col)) == NOTHING, F.array().cast("array<string>")).otherwise(parts)


def encode_labels(tags: Column) -> Column:
    """Label ids; a tag that is none of LABELS has -1."""
    return F.transform(tags, lambda t: (F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABELS]), t), F.lit(0)) - 1).cast("int"))


def decode_labels(ids: Column) -> Column:
    """Tags of label ids; ids that have none become O."""
    return F.transform(ids, lambda i: F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), i), F.lit("O")))


def argmax(scores: Column) -> Column:
    """Place of the greatest score, the lowest of equal ones; null for a null or empty array."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def kept_labels(values: Column, labels: Column) -> Column:
    """values where labels is not IGNORED, position by position; the longer array is cut to the other."""
    n = F.least(F.size(values), F.size(labels))
    pairs = F.zip_with(F.slice(values, F.lit(1), n), F.slice(labels, F.lit(1), n), lambda v, label: F.struct(v.alias("v"), label.alias("l")))
    return F.transform(F.filter(pairs, lambda p: p["l"] != IGNORED), lambda p: p["v"])


def first_pieces(pieces: Column) -> Column:
    """Prediction of the first piece of each word: pieces are struct<word:int,value:...> in order; null words are
    special pieces and are skipped."""
    whole = F.filter(pieces, lambda p: p["word"].isNotNull())
    return let(whole, lambda ps: F.transform(F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["word"] != p["word"])), lambda p: p["value"]))


def align_labels(word_ids: Column, tags: Column) -> Column:
    """Labels of subword pieces: IGNORED for special pieces, a word's tag for its first piece, that tag as I for the others;
    -1 for a tag that is none of LABELS or a word that has none."""
    return F.arrow_udf(aligned_of(LABELS, IGNORED), "array<int>")(word_ids, tags)


def token_outcome(truth: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN of one word by whether its true and its predicted tag mark an entity."""
    t, p = truth.rlike("^[BI]-"), predicted.rlike("^[BI]-")
    return F.when(t & p, "TP").when(p, "FP").when(t, "FN").otherwise("TN")
