"""Dataset-JSON documents: structure checks and extraction of item groups.

A document is one row of text, so a collection of documents is parsed in parallel by
ordinary ``from_json`` expressions. A well-formed document takes one typed parse; kinds and odd
elements are looked into only where that fails. A value counts as what it is: a text that
holds JSON is a text. A document that is no JSON text from end to end (cut off, or with more text after
its end) is unreadable, which is all that is said of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import (
    LIST,
    STRINGS,
    class_of_field,
    class_of_variant,
    entry,
    is_class,
    text_of_variant,
    truthy_field,
    truthy_variant,
    unique_entries,
    variant_is,
)
from ..functions.text import quoted
from ..operators.findings import Hit, found, unpack
from ..rules import texts as X

MAX_COLUMNS = 10_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: doc_id (its path) and doc (its whole text)."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.selectExpr("_metadata.file_path AS doc_id", "value AS doc")


@dataclass(frozen=True)
class DatasetJson:
    """Documents with columns ``doc_id`` and ``doc``."""

    docs: DataFrame
    finding_type: str = X.DATASET_JSON

    # -- structure ---------------------------------------------------------------

    def parsed(self) -> DataFrame:
        """Per document: ``doc_notes`` (findings), ``pairs``, the item groups in document order, and ``root_name``.

        A group's value is a ``_DATASET`` struct, null if it is no object. One typed parse settles a well-formed
        document; it also tells whether the text ends where the document does, as the document is read
        inside of another one whose only other field holds the text's own digest.
        """
        whole = "concat('{\"doc\":', doc, ',\"end\":\"', md5(doc), '\"}')"
        typed = f"from_json({whole}, 'doc STRUCT<{_roots(_DATASET_MAP)}>, end STRING', {_STRICT})"
        cd, rd = "roots.clinicalData", "roots.referenceData"
        # Groups of a sound root: an empty clinicalData leaves the word to referenceData, and so does none.
        fast_pairs = (
            "CASE WHEN p.doc.clinicalData.itemGroupData IS NOT NULL THEN map_entries(p.doc.clinicalData.itemGroupData)"
            " WHEN NOT array_contains(top_keys, 'clinicalData') THEN map_entries(p.doc.referenceData.itemGroupData) END"
        )
        odd_clinical = (
            f"CASE WHEN {cd} IS NULL AND array_contains(top_keys, 'clinicalData')"
            f" THEN {truthy_field('doc', 'clinicalData')} ELSE FALSE END"
        )
        root_class = (
            f"CASE WHEN root_name IS NOT NULL THEN NULL"
            f" WHEN odd_clinical THEN {class_of_field('doc', 'clinicalData')}"
            f" ELSE {class_of_field('doc', 'referenceData')} END"
        )
        root_name = (
            "CASE WHEN fast IS NOT NULL AND p.doc.clinicalData.itemGroupData IS NOT NULL THEN 'clinicalData'"
            f" WHEN fast IS NOT NULL THEN 'referenceData' WHEN size({cd}) > 0 THEN 'clinicalData'"
            f" WHEN NOT odd_clinical AND {rd} IS NOT NULL THEN 'referenceData' END"
        )
        # Where a group is no object, each is told by its kind; a text that holds JSON stays a text.
        kinds = f"from_json(doc, '{_roots('MAP<STRING, VARIANT>')}')"
        slow_pairs = (
            f"transform(zip_with(map_entries({_of_root(_texts('doc'))}), map_entries({_of_root(kinds)}),"
            f" (t, k) -> named_struct('key', t.key, 'text', t.value, 'kind', {class_of_variant('k.value')})),"
            f" z -> named_struct('key', z.key, 'value', CASE WHEN {is_class('z.kind', 'dict')} THEN from_json(z.text, '{_DATASET_FIELDS}') END))"
        )
        # The raw text of the root is needed only to name the kind of a misplaced itemGroupData.
        root_text = f"CASE root_name WHEN 'clinicalData' THEN from_json(doc, 'clinicalData STRING').clinicalData ELSE from_json(doc, 'referenceData STRING').referenceData END"
        groups_class = (
            f"CASE WHEN root_name IS NOT NULL AND has_groups AND raw_pairs IS NULL"
            f" THEN {class_of_field(f'({root_text})', 'itemGroupData')} END"
        )
        has_groups = (
            "fast IS NOT NULL OR coalesce(array_contains(map_keys(CASE root_name"
            f" WHEN 'clinicalData' THEN {cd} ELSE {rd} END), 'itemGroupData'), FALSE)"
        )
        return (
            self.docs.selectExpr("doc_id", "doc", f"{typed} AS p", "coalesce(json_object_keys(doc), array()) AS top_keys")
            .selectExpr("doc_id", "doc", "p", "top_keys", f"coalesce(p.end = md5(doc) AND json_object_keys({whole}) = array('doc', 'end'), FALSE) AS readable")
            .selectExpr("*", f"CASE WHEN readable THEN {fast_pairs} END AS fast")
            .selectExpr("*", f"CASE WHEN readable AND fast IS NULL THEN from_json(doc, 'clinicalData {STRINGS}, referenceData {STRINGS}') END AS roots")
            .selectExpr("*", f"{odd_clinical} AS odd_clinical")
            .selectExpr("*", f"{root_name} AS root_name")
            .selectExpr("*", f"{has_groups} AS has_groups")
            .selectExpr("*", f"CASE WHEN fast IS NOT NULL THEN fast WHEN has_groups THEN {slow_pairs} END AS raw_pairs")
            .selectExpr("*", f"{root_class} AS root_class", f"{groups_class} AS groups_class")
            .selectExpr(
                "doc_id", "doc", "root_name",
                f"coalesce({unique_entries('raw_pairs')}, array()) AS pairs",
                f"{found(self._top_level_hits())} AS doc_notes",
            )
        )

    def _note(self, mask: str, rule_id: str, field_: str = "", evidence: str = "''", **sql: str) -> Hit:
        severity, message = X.DJ_TEXTS[rule_id]
        return Hit(
            mask, self.finding_type, rule_id, severity, X.DATASET_JSON, field_, message, evidence=evidence, **sql
        )

    def _top_level_hits(self) -> list[Hit]:
        rootless = "readable AND NOT array_contains(top_keys, 'clinicalData') AND NOT array_contains(top_keys, 'referenceData')"
        _, missing = X.DJ_TEXTS["DJ_000"]
        # Nothing else can be said of a text that is no JSON document.
        start = f"coalesce(substr(doc, 1, {X.EVIDENCE_CHARS}), 'None')"
        return [
            self._note("NOT readable", X.DJ_UNREADABLE, "document", start),
            *[
                self._note(
                    f"readable AND NOT array_contains(top_keys, '{key}')", "DJ_000", key,
                    message_sql=quoted(missing.replace("%s", key)),
                )
                for key in X.DJ_TOP_LEVEL
            ],
            self._note(rootless, "DJ_001", "clinicalData/referenceData"),
            self._note(f"readable AND NOT ({rootless}) AND root_name IS NULL", "DJ_002", "clinicalData/referenceData", "root_class"),
            self._note("root_name IS NOT NULL AND NOT has_groups", "DJ_003", "itemGroupData"),
            self._note(
                "root_name IS NOT NULL AND has_groups AND raw_pairs IS NULL", "DJ_004", "itemGroupData", "groups_class"
            ),
        ]

    def validate_top_level(self) -> DataFrame:
        """DJ_000 to DJ_004, or that the document cannot be read."""
        return unpack(self.parsed(), "doc_notes", ["doc_id"])

    def itemgroups(self) -> DataFrame:
        """Per document the OIDs in document order."""
        return self.parsed().selectExpr("doc_id", "transform(pairs, p -> p.key) AS oids")

    def itemgroup_oids(self, domains: Sequence[str]) -> DataFrame:
        """Per document and domain the OID found for it, or null."""
        return self.parsed().selectExpr(
            "doc_id", f"inline(array({', '.join(self._target(d) for d in domains)}))"
        ).drop("infer")

    def group_columns(self, domains: Sequence[str]) -> DataFrame:
        """Per document and domain its OID and the column names of its items, in order."""
        return self._groups([self._target(d) for d in domains], strict=False).select("doc_id", "domain", "oid", "item_names")

    # -- extraction --------------------------------------------------------------

    @staticmethod
    def _target(domain: str) -> str:
        """A dataset named like the domain, else the first key that ends in it or holds '.DOMAIN'."""
        wanted = domain.strip().upper()
        name = f"CASE WHEN {variant_is('p.value.name', 'STRING')} THEN upper(variant_get(p.value.name, '$', 'string')) END"
        by_name = f"filter(pairs, p -> p.value IS NOT NULL AND coalesce({name}, '') = {quoted(wanted)})"
        by_key = (
            f"filter(pairs, p -> endswith(upper(p.key), {quoted(wanted)})"
            f" OR contains(upper(p.key), {quoted('.' + wanted)}))"
        )
        return (
            f"named_struct('domain', {quoted(domain)}, 'infer', TRUE,"
            f" 'oid', coalesce(get({by_name}, 0).key, get({by_key}, 0).key))"
        )

    @staticmethod
    def _cut_out(oid: str) -> str:
        """The group ``oid`` as (ds, text): the text only where items or records are not what they should be."""
        ds = entry("pairs", oid)
        text = entry(f"map_entries({_of_root(_texts('doc'))})", oid)
        return (
            f"transform(array({ds}), d -> named_struct('ds', d,"
            f" 'text', CASE WHEN d IS NOT NULL AND NOT ({_sound('d')}) THEN {text} END))[0]"
        )

    @staticmethod
    def _with_items(rows: DataFrame) -> DataFrame:
        """Rows with ``g`` of ``_cut_out``: adds items_ok, no_items, item_classes and item_names."""
        # Fast path: every item is an object. Otherwise each one is looked at alone.
        odd_classes = (
            f"CASE WHEN items_ok OR g.text IS NULL THEN array()"
            f" WHEN odd_items IS NOT NULL THEN transform(odd_items, v -> {class_of_variant('v')})"
            # Walking an object yields its keys, walking a text its characters.
            f" WHEN {is_class('items_class', 'dict')}"
            f" THEN transform(array_distinct(json_object_keys(from_json(g.text, 'items STRING').items)), k -> {quoted(_STR)})"
            f" WHEN {is_class('items_class', 'str')} THEN array_repeat({quoted(_STR)}, length(from_json(g.text, 'items STRING').items))"
            f" ELSE array() END"
        )
        names = (
            f"CASE WHEN items_ok THEN transform(g.ds.items, (x, i) -> {_item_name('x.name', 'x.OID', 'i')})"
            " WHEN odd_items IS NULL THEN array()"
            " ELSE transform(filter(transform(odd_items, (v, i) -> named_struct('n',"
            f" {_item_name(_part('v', 'name'), _part('v', 'OID'), 'i')}, 'c', item_classes[i])),"
            f" z -> {is_class('z.c', 'dict')}), z -> z.n) END"
        )
        # A repeated column name gets its number appended; later names keep their place.
        distinct_names = (
            "CASE WHEN size(array_distinct(names)) = size(names) THEN names ELSE transform(names, (x, i) ->"
            " CASE WHEN i > 0 AND array_contains(slice(names, 1, i), x)"
            " THEN concat(x, '_', 1 + size(filter(slice(names, 1, i), y -> y = x))) ELSE x END) END"
        )
        return (
            rows.selectExpr("*", f"coalesce({_all_there('g.ds.items')}, FALSE) AS items_ok")
            .selectExpr("*", "CASE WHEN NOT items_ok THEN from_json(g.text, 'items ARRAY<VARIANT>').items END AS odd_items")
            .selectExpr("*", "CASE WHEN items_ok THEN size(g.ds.items) ELSE coalesce(size(odd_items), 0) END = 0 AS no_items")
            .selectExpr("*", f"CASE WHEN g.text IS NOT NULL AND NOT items_ok AND odd_items IS NULL THEN {class_of_field('g.text', 'items')} END AS items_class")
            .selectExpr("*", f"{odd_classes} AS item_classes")
            .selectExpr("*", f"{names} AS names")
            .selectExpr("*", f"{distinct_names} AS item_names")
            .drop("odd_items", "items_class", "names")
        )

    def _anchored(self, anchor: str | None) -> DataFrame:
        """``parsed`` with two facts about one domain of the same document, for checks that hang on it."""
        kept = ["doc_id", "doc", "root_name", "pairs", "doc_notes"]
        if anchor is None:
            return self.parsed().selectExpr(*kept, "FALSE AS anchor_rows", "FALSE AS anchor_has_id")
        usable = (
            f"CASE WHEN {_all_there('g.ds.itemData')} THEN size(g.ds.itemData) > 0"
            f" ELSE exists(from_json(g.text, 'itemData ARRAY<VARIANT>').itemData, v -> {is_class(f'({class_of_variant("v")})', 'list')}) END"
        )
        with_group = self.parsed().selectExpr(*kept, f"{self._target(anchor)}.oid AS anchor_oid")
        return self._with_items(with_group.selectExpr(*kept, f"{self._cut_out('anchor_oid')} AS g")).selectExpr(
            *kept,
            f"coalesce({usable}, FALSE) AND size(item_names) > 0 AS anchor_rows",
            "array_contains(item_names, 'USUBJID') AS anchor_has_id",
        )

    def _groups(self, targets: Sequence[str], strict: bool, anchor: str | None = None) -> DataFrame:
        """One row per document and targeted group: its column names, its records, its findings."""
        # The groups are cut out before the explode, so a row carries its own group and not the document.
        cut_out = f"transform(array({', '.join(targets)}), t -> named_struct('domain', t.domain, 'infer', t.infer, 'oid', t.oid, 'g', {self._cut_out('t.oid')}))"
        carried = ["doc_id", "anchor_rows", "anchor_has_id", "doc_notes", "all_oids"]
        rows = (
            self._anchored(anchor)
            .selectExpr(*carried[:4], "array_join(transform(pairs, p -> p.key), ';') AS all_oids", f"{cut_out} AS groups")
            .selectExpr(*carried, "posexplode_outer(groups) AS (nth, t)")
            .selectExpr(*carried[:3], "CASE WHEN nth = 0 THEN doc_notes ELSE array() END AS doc_notes", "all_oids", "t.*")
            .selectExpr("*", "g.ds IS NOT NULL AS found")
        )
        return (
            self._with_items(rows)
            .selectExpr("*", f"coalesce({_all_there('g.ds.itemData')}, FALSE) AS data_ok")
            .selectExpr("*", "NOT data_ok AND coalesce(from_json(g.text, 'itemData ARRAY<STRING>').itemData IS NULL, TRUE) AS no_data")
            .selectExpr("*", f"CASE WHEN found AND no_data THEN {class_of_field('g.text', 'itemData')} END AS data_class")
            .selectExpr(
                "doc_id", "domain", "oid", "anchor_rows", "anchor_has_id", "item_names", "g", "data_ok",
                f"size(item_names) > 0 AND NOT no_data{' AND NOT no_items' if strict else ''} AS has_data",
                f"concat(doc_notes, {self._group_notes(strict)}) AS group_notes",
            )
        )

    def _records(self, targets: Sequence[str], strict: bool, anchor: str | None = None) -> DataFrame:
        """One row per record of the targeted groups, and one for a group without records.

        ``row_index`` counts the usable records (null for a skipped one), ``src_index`` all of
        them. ``notes`` holds the findings; those about the document or the group sit on the
        first row, so a single pass over the documents yields data and findings alike.
        """
        # Fast path: every record is an array. Otherwise kinds are told per record.
        told = (
            "transform(zip_with(from_json(g.text, 'itemData ARRAY<STRING>').itemData, from_json(g.text, 'itemData ARRAY<VARIANT>').itemData,"
            f" (t, v) -> named_struct('t', t, 'kind', {class_of_variant('v')})), (z, i) -> named_struct('src_index', i,"
            f" 'kind', z.kind, 'cells', CASE WHEN {is_class('z.kind', 'list')} THEN from_json(z.t, '{LIST}') END))"
        )
        usable = is_class("r.kind", "list")
        rows = (
            f"CASE WHEN NOT has_data THEN array() WHEN data_ok THEN transform(g.ds.itemData, (x, i) -> {_row('i', 'i', 'x', quoted(_LIST))}) ELSE concat("
            f"transform(filter(told, r -> {usable}), (r, j) -> {_row('j', 'r.src_index', 'r.cells', 'r.kind')}),"
            f" transform(filter(told, r -> NOT {usable}),"
            f" r -> {_row('CAST(NULL AS INT)', 'r.src_index', 'CAST(NULL AS ARRAY<STRING>)', 'r.kind')})) END"
        )
        quiet = f"pos > 0 AND {is_class('rec.kind', 'list')} AND size(rec.cells) = size(item_names)"
        notes = (
            f"CASE WHEN {quiet} THEN array() ELSE concat("
            "CASE WHEN coalesce(pos, 0) = 0 THEN group_notes ELSE array() END,"
            f" CASE WHEN rec IS NOT NULL THEN {found(self._record_hits())} ELSE array() END) END"
        )
        group = ["doc_id", "domain", "oid", "anchor_rows", "anchor_has_id", "item_names"]
        return (
            self._groups(targets, strict, anchor)
            .selectExpr(*group, "group_notes", "g", "has_data", "data_ok", f"CASE WHEN has_data AND NOT data_ok THEN {told} END AS told")
            .selectExpr(*group, "group_notes", f"posexplode_outer({rows}) AS (pos, rec)")
            .selectExpr(
                *group, "CAST(rec.row_index AS BIGINT) AS row_index", "CAST(rec.src_index AS BIGINT) AS src_index",
                "rec.cells AS cells", f"{notes} AS notes",
            )
        )

    def _group_notes(self, strict: bool) -> str:
        not_inferred = X.DJ_TEXTS["DJ_110"][1]
        not_found = X.DJ_TEXTS["DJ_100"][1]
        alone = [
            self._note(
                "infer AND oid IS NULL", "DJ_110", "domain", "all_oids", message_sql=_filled(not_inferred, "domain")
            ),
            self._note(
                "oid IS NOT NULL AND NOT found", "DJ_100", "itemGroupData", "all_oids",
                message_sql=_filled(not_found, "oid"),
            ),
            self._note("found AND no_items", "DJ_101", field_sql="concat(oid, '.items')"),
        ]
        # In strict mode the first of DJ_101 and DJ_102 ends the work on the group.
        on_data = "found AND no_data" + (" AND NOT no_items" if strict else "")
        goes_on = "found AND NOT (no_items OR no_data)" if strict else "found"
        alone.append(self._note(on_data, "DJ_102", evidence="data_class", field_sql="concat(oid, '.itemData')"))
        severity, message = X.DJ_TEXTS["DJ_103"]
        # One finding per odd element, so these come from the array itself.
        odd_item = Hit(
            "TRUE", self.finding_type, "DJ_103", severity, X.DATASET_JSON, "", message,
            evidence="z.c", field_sql="concat(oid, '.items[', z.i, ']')",
        )
        odd_items = (
            f"CASE WHEN {goes_on} THEN transform(filter("
            f"transform(item_classes, (c, i) -> named_struct('c', c, 'i', i)), z -> NOT ({is_class('z.c', 'dict')})),"
            f" z -> {odd_item.as_struct()}) ELSE array() END"
        )
        nameless = [
            self._note(f"{goes_on} AND size(item_names) = 0", "DJ_104", field_sql="concat(oid, '.items')")
        ]
        return f"concat({found(alone)}, {odd_items}, {found(nameless)})"

    def _record_hits(self) -> list[Hit]:
        place = "concat(oid, '.itemData[', rec.src_index, ']')"
        usable = is_class("rec.kind", "list")
        lengths = "concat('len(record)=', size(rec.cells), ' len(items)=', size(item_names))"
        return [
            self._note(f"NOT ({usable})", "DJ_105", evidence="rec.kind", field_sql=place, row_index="rec.src_index"),
            self._note(
                f"{usable} AND size(rec.cells) <> size(item_names)", "DJ_106", evidence=lengths, field_sql=place,
                row_index="rec.src_index",
            ),
        ]

    def records(self, domains: Sequence[str], strict: bool = False, anchor: str | None = None) -> DataFrame:
        """Records of the groups inferred for the domains, see ``_records``."""
        return self._records([self._target(d) for d in domains], strict, anchor)

    def itemgroup_records(self, oids: Sequence[str], strict: bool = False) -> DataFrame:
        """Records of groups named by OID; ``domain`` holds the OID."""
        return self._records([_named_group(o) for o in oids], strict)

    def domain_table(self, domain: str, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
        """The domain as a table: doc_id, row_index, src_index and one string column per item.

        Unless ``columns`` names the items wanted, the documents' items are listed first.
        """
        return self._table([self._target(domain)], columns, strict)

    def itemgroup_table(self, oid: str, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
        return self._table([_named_group(oid)], columns, strict)

    def _table(self, targets: Sequence[str], columns: Sequence[str] | None, strict: bool) -> DataFrame:
        wanted = column_names(self._groups(targets, strict)) if columns is None else columns
        usable = self._records(targets, strict).filter("row_index IS NOT NULL")
        return usable.selectExpr("doc_id", "row_index", "src_index", *[f"{cell(c)} AS `{c}`" for c in wanted])


def findings_of(records: DataFrame) -> DataFrame:
    """The findings that extraction left on the records."""
    return unpack(records, "notes", ["doc_id"])


def cell(column: str) -> str:
    """Value of a column in a record; null where the record is short or the column absent."""
    return f"get(cells, CAST(array_position(item_names, {quoted(column)}) AS INT) - 1)"


def column_names(groups: DataFrame) -> list[str]:
    """All item names in use, in item order. A name is schema, so there must be a sane number of them."""
    names = (
        groups.selectExpr("posexplode(item_names) AS (place, name)")
        .groupBy("name")
        .agg(F.min("place").alias("place"))
        .orderBy("place", "name")
        .limit(MAX_COLUMNS + 1)
        .collect()
    )
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} distinct item names: pass the columns you need")
    return [r["name"] for r in names]


_LIST, _STR = (f"<class '{kind}'>" for kind in ("list", "str"))
# What a dataset should be; names keep their kind, cells become text.
_DATASET_FIELDS = "name VARIANT, items ARRAY<STRUCT<name: VARIANT, OID: VARIANT>>, itemData ARRAY<ARRAY<STRING>>"
_DATASET_MAP = f"MAP<STRING, STRUCT<{_DATASET_FIELDS}>>"
# As strict as JSON itself.
_STRICT = "map('allowSingleQuotes', 'false')"


def _roots(groups: str) -> str:
    """Schema of a document whose item groups have the type ``groups``."""
    return f"clinicalData STRUCT<itemGroupData: {groups}>, referenceData STRUCT<itemGroupData: {groups}>"


def _texts(doc: str) -> str:
    """Item groups as texts; a text that stands where a group should be is told by its kind elsewhere."""
    return f"from_json({doc}, '{_roots('MAP<STRING, STRING>')}')"


def _of_root(roots: str) -> str:
    return f"transform(array({roots}), r -> CASE root_name WHEN 'clinicalData' THEN r.clinicalData.itemGroupData ELSE r.referenceData.itemGroupData END)[0]"


def _all_there(array: str) -> str:
    return f"({array} IS NOT NULL AND NOT exists({array}, x -> x IS NULL))"


def _sound(ds: str) -> str:
    """Whether items and records are arrays of what they should be."""
    return f"{_all_there(f'{ds}.items')} AND {_all_there(f'{ds}.itemData')}"


def _part(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def _named_group(oid: str) -> str:
    return f"named_struct('domain', {quoted(oid)}, 'infer', FALSE, 'oid', {quoted(oid)})"


def _item_name(name: str, oid: str, index: str) -> str:
    """The first of the two that is neither missing nor empty, zero or false; else a name by place."""
    usable = f"filter(array({name}, {oid}), w -> {truthy_variant('w')})"
    return f"coalesce(get(transform({usable}, w -> {text_of_variant('w')}), 0), concat('COL_', {index}))"


def _filled(message: str, column: str) -> str:
    before, after = message.split("%s")
    return f"concat({quoted(before)}, {column}, {quoted(after)})"


def _row(row_index: str, src_index: str, cells: str, kind: str) -> str:
    return f"named_struct('row_index', {row_index}, 'src_index', {src_index}, 'cells', {cells}, 'kind', {kind})"
