"""Queries of the training-data operators over the tables of a directory, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN_RE
from . import encoding, frequencies, lookalikes, mixing, packing, quality, reading, sampling, scans, sentences
from .sizes import sized


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "lexicon").select("word").unionByName(_t(spark, folder, "common_words").select("word"))


def _sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    plans = _t(spark, folder, "sample_plans").where("of_table = 'primer_records'")
    return sampling.sample_to_targets(_t(spark, folder, "primer_records"), plans, _t(spark, folder, "sample_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.unmet_targets(_sample(spark, folder)[1])


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[0]


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1]


def p1_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Wishes, records and what can be met, from the report."""
    return p1_report(spark, folder).select("plan_id", "target_id", "wanted", "available", "met")


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of each plan the drawn records and distinct files, and whether every cell kept its minimum as far as there are records."""
    sample, report = _sample(spark, folder)
    floors = _t(spark, folder, "sample_targets").join(_t(spark, folder, "sample_plans"), "plan_id").where("coalesce(min_records, 0) <= sample_size")
    floors = floors.select("plan_id", "target_id", F.coalesce("min_records", F.lit(0)).alias("least"))
    kept = report.join(floors, ["plan_id", "target_id"]).groupBy("plan_id").agg(F.every(F.col("drawn") >= F.least("least", "available")).alias("floors_kept"))
    return sample.groupBy("plan_id").agg(F.count("*").alias("drawn"), F.countDistinct("file").alias("files")).join(kept, "plan_id")


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _t(spark, folder, "documents")
    return scans.scan_defects(docs, scans.corpus_lexicon(docs, _t(spark, folder, "lexicon")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.damaged_lines(_scans(spark, folder))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).select("doc_id", F.size("defects").alias("defects"), "repaired")


def _corpus_scans(spark: SparkSession, folder: str, corpus: str, id_col: str) -> DataFrame:
    rows = _t(spark, folder, corpus)
    found = scans.scan_defects(rows, scans.corpus_lexicon(rows, _t(spark, folder, "lexicon")), id_col)
    return found.select(id_col, F.size("defects").alias("defects"), "repaired")


def p2_primer_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus_scans(spark, folder, "primer_records", "rec_id")


def p2_works_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Works have no number of a delivery: one row for each row of a file."""
    return _corpus_scans(spark, folder, "works_records", "file")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tasks = _t(spark, folder, "seg_tasks").select("doc_id").where("doc_id is not null").distinct()
    docs = _t(spark, folder, "documents").select("doc_id", "text").join(tasks, "doc_id", "left_semi")
    return sentences.sentence_units(docs).select("doc_id", "end_pos")


def p3_units(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(_t(spark, folder, "documents"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _t(spark, folder, "documents")
    return frequencies.bands(frequencies.term_frequencies(docs), docs)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies.marked_terms(_terms(spark, folder))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.lookalike_pairs(lookalikes.normalise_lookalikes(_t(spark, folder, "documents"), keep_form=False))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.class_members(lookalikes.normalise_lookalikes(_t(spark, folder, "documents"), keep_form=False))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.normalise_lookalikes(_t(spark, folder, "documents")).select("doc_id", "form", "look_key")


def _corpus_forms(spark: SparkSession, folder: str, corpus: str, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    rows = _t(spark, folder, corpus)
    forms = [lookalikes.normalise_lookalikes(rows, id_col, f).select(id_col, F.lit(f).alias("field"), "form", "look_key") for f in fields]
    return reduce(DataFrame.unionByName, forms)


def p5_primer_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus_forms(spark, folder, "primer_records", "rec_id", ("text", "type", "category", "subject"))


def p5_works_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus_forms(spark, folder, "works_records", "file", ("text", "type", "source", "subject", "topic"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_statistics(_t(spark, folder, "documents"), _t(spark, folder, "common_words"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.mostly_structure(_quality(spark, folder)).select("doc_id")


def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.misgraded(p7_levels(spark, folder))


def p7_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(_t(spark, folder, "primer_records"), _words(spark, folder))


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_containers(sized(_t(spark, folder, "documents")), _t(spark, folder, "pack_specs"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_documents(_containers(spark, folder))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_fill(_containers(spark, folder))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Of each plan the documents, pieces, tokens and overfull containers."""
    c = _containers(spark, folder)
    bins = c.groupBy("spec_id", "container").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"))
    over = bins.groupBy("spec_id").agg(F.count_if(F.col("size") > F.col("capacity")).alias("overfull"))
    sums = c.groupBy("spec_id").agg(F.count_if(F.col("part") == 0).alias("documents"), F.count("*").alias("pieces"), F.sum("size").alias("tokens"))
    return sums.join(over, "spec_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = sized(_t(spark, folder, "documents"))
    wishes = mixing.wanted(sizes, _t(spark, folder, "mix_plans"), _t(spark, folder, "mix_targets"))
    return mixing.mix_sources(sizes, wishes), wishes


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.unreached_targets(mixing.mix_report(*_mix(spark, folder)))


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, folder))


def p9_wishes(spark: SparkSession, folder: str) -> DataFrame:
    """Wished shares, whether they can be reached, and whether what is given is within a document of it and no document is used too often."""
    uses, wishes = _mix(spark, folder)
    largest = sized(_t(spark, folder, "documents")).groupBy("source").agg(F.max("size").alias("largest"))
    r = mixing.mix_report(uses, wishes).join(wishes.select("mix_id", "source", "has_tokens"), ["mix_id", "source"]).join(largest, "source", "left")
    due = F.least("wanted_tokens", F.coalesce(F.col("max_uses") * F.col("has_tokens"), F.col("wanted_tokens")))
    near = F.abs(F.col("given_tokens") - due) <= F.coalesce("largest", F.lit(0)) + 1e-6
    return r.select("mix_id", "source", F.round("wanted_tokens", 6).alias("wanted_tokens"), F.round("wanted_share", 9).alias("wanted_share"), "reached", near.alias("near"), (F.col("most_uses") <= F.coalesce("max_uses", "most_uses")).alias("uses_kept"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_repaired(spark, folder).select("doc_id")


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair_encoding(_t(spark, folder, "documents"), _words(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_sample, p1_report, p1_targets, p1_kept, p2_found, p2_repaired, p2_primer_repaired, p2_works_repaired, p3_found, p3_units, p4_found, p4_terms, p5_found, p5_classes, p5_forms, p5_primer_forms, p5_works_forms, p6_found, p6_statistics,
        p7_found, p7_levels, p8_found, p8_containers, p8_fill, p8_pieces, p9_found, p9_uses, p9_shares, p9_wishes, p10_found, p10_repaired,
    )
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Tables of the SQL, made apart from the operator's: width by the public character names, spaces and invisible characters by
# category, and the letters that look alike written out.
def _narrow(c: str) -> str | None:
    name = unicodedata.name(c, "")
    if not name.startswith(("FULLWIDTH ", "HALFWIDTH ")):
        return None
    name = name.partition(" ")[2]
    if name.endswith("VOICED SOUND MARK"):
        name = "COMBINING " + name.replace("KATAKANA", "KATAKANA-HIRAGANA")
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


_BMP = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) != "Cs"]
_NARROW = {c: n for c in _BMP if (n := _narrow(c))} | {c: " " for c in _BMP if unicodedata.category(c) == "Zs"}
_GONE = [c for c in _BMP if unicodedata.category(c) == "Cf" or unicodedata.name(c, "").startswith("VARIATION SELECTOR")] + ["\r", "\u034f"]
# Letter and its look-alike in the script that comes first.
_ALIKE = (
    "аa сc еe іi јj оo рp ѕs хx уy һh ԛq ԝw ԁd ӏl ѵv АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX ҮY ԌG ԚQ ԜW ёë ЁË їï ЇÏ ѐè ЀÈ οo νv ϲc ϳj ρp ΑA ΒB ϹC ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΧX ΥY ΖZ ꓜZ ΪÏ ΓГ ΠП ΦФ ᴧЛ"
).split()
_ALIKE = {a: b for a, b in _ALIKE}


def _mapped(expr: str, table: dict[str, str], gone: list[str] = []) -> str:
    """SQL that maps single characters; translate drops those without a target."""
    return f"translate({expr}, {_text(''.join(table) + ''.join(gone))}, {_text(''.join(table.values()))})"


_FORM = "nfc_normalize(" + _mapped("{0}", _NARROW, _GONE) + ")"
_SMALL = {a: b for a, b in _ALIKE.items() if a.islower() and b.islower()} | {a.lower(): b.lower() for a, b in _ALIKE.items()} | {"ë": "e", "ё": "e"}
_LABEL = "regexp_replace(" + _mapped("lower(" + _mapped(_FORM, _ALIKE) + ")", _SMALL) + ", '[^\\p{L}\\p{N}]', '', 'g')"

_SIZE = f"coalesce(len(regexp_extract_all(text, {_text(TOKEN_RE)})), 0)"

_P1_CELLS = f"""
state as (select file, max_by(struct_pack(t := type, y := year, c := category), struct_pack(known := loaded_at is not null, tm := loaded_at, id := rec_id)) s from primer_records where file is not null group by file),
labels as (select {_LABEL.replace("{0}", "s.t")} as type_key, s.y as year, {_LABEL.replace("{0}", "s.c")} as category_key, count(*) n from state group by all),
targets as (select distinct t.plan_id, target_id, t.type is null as any_type, {_LABEL.replace("{0}", "t.type")} as type_key, year_from, year_to, category is null as any_category, {_LABEL.replace("{0}", "category")} as category_key,
  greatest(round(share * sample_size), min_records) as wanted from sample_targets t join sample_plans p on p.plan_id = t.plan_id and of_table = 'primer_records'),
cells as (select plan_id, target_id, wanted, coalesce(sum(n), 0) as has from targets t left join labels l on (any_type or t.type_key = l.type_key) and (any_category or t.category_key = l.category_key)
  and (year_from is null or l.year >= year_from) and (year_to is null or l.year <= year_to) group by all)
"""

_P4_TERMS = """
runs as (select rowid as r, unnest(regexp_extract_all(lower(text), '[a-zа-яё]+')) as term from (select row_number() over () as rowid, text from documents)),
terms as (select term, count(*) as n, count(distinct r) as docs from runs group by term),
banded as (select term, n, docs, case when docs < 3 then 'rare' when docs > 0.3 * (select count(text) from documents) then 'common' else 'useful' end as band from terms)
"""

_P5_SEEN = f"keyed as (select doc_id, text, {_mapped(_FORM.replace('{0}', 'text'), _ALIKE)} as k from documents where text is not null), seen as (select doc_id, text, md5(k) as k from keyed where regexp_matches(k, '[^\\s]'))"
_P8_PARTS = f"parts as (select spec_id, doc_id, size, greatest(ceil(size / capacity::double), 1)::bigint as n from (select doc_id, source, {_SIZE} as size from documents) d join (select distinct spec_id, source, capacity from pack_specs where capacity > 0) s on s.source is null or s.source = d.source)"
_P9_WISHES = (
    f"has as (select source, sum({_SIZE}) as tokens from documents where source is not null group by source), t as (select distinct mix_id, source, weight, max_uses from mix_targets where weight > 0), "
    "w as (select mix_id, sum(weight) as weights from t group by mix_id), wish as (select t.mix_id, t.source, weight / weights as share, weight / weights * budget_tokens as tokens, max_uses, coalesce(h.tokens, 0) as has from t join w using (mix_id) join mix_plans p using (mix_id) left join has h on h.source = t.source)"
)

SQL: dict[str, str] = {
    "p1_found": f"with {_P1_CELLS} select plan_id, target_id from cells where has < wanted",
    "p4_found": f"with {_P4_TERMS} select term, band from banded where band <> 'useful'",
    "p4_terms": f"with {_P4_TERMS} select term, n, docs, band from banded",
    "p1_targets": f"with {_P1_CELLS} select plan_id, target_id, wanted::bigint as wanted, has::bigint as available, has >= wanted as met from cells",
    "p1_kept": "select plan_id, least(sample_size, (select count(distinct file) from primer_records)) as drawn, least(sample_size, (select count(distinct file) from primer_records)) as files, true as floors_kept from sample_plans where of_table = 'primer_records' and sample_size > 0",
    "p5_found": f"with {_P5_SEEN} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from seen a join seen b on a.k = b.k and a.doc_id < b.doc_id and a.text <> b.text",
    "p5_classes": f"with {_P5_SEEN}, c as (select k, min(doc_id) as class, count(distinct text) as spellings from seen group by k having count(distinct text) > 1) select doc_id, class, min(doc_id) over (partition by k, text) as spelling, spellings from seen join c using (k)",
    "p8_pieces": f"with {_P8_PARTS} select spec_id, count(*) as documents, sum(n)::bigint as pieces, sum(size)::bigint as tokens, 0::bigint as overfull from parts group by spec_id",
    "p9_wishes": f"with {_P9_WISHES} select mix_id, source, round(tokens, 6) as wanted_tokens, round(share, 9) as wanted_share, not tokens > max_uses * has as reached, true as near, true as uses_kept from wish",
    "p8_found": f"select distinct spec_id, doc_id from (select doc_id, source, {_SIZE} as size from documents) d join (select distinct spec_id, source, capacity from pack_specs where capacity > 0) s on (s.source is null or s.source = d.source) and d.size > s.capacity",
    "p9_found": f"with {_P9_WISHES} select mix_id, source from wish where tokens > max_uses * has",
}
