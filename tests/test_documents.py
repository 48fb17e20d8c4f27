"""Dataset-JSON: structure, extraction and whole documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import studylens as sl
from studylens.sources.dataset_json import findings_of

HEAD = {"creationDateTime": "2019-11-30T08:15:00", "datasetJSONVersion": "1.0.9"}


def with_groups(groups):
    return {**HEAD, "clinicalData": {"itemGroupData": groups}}


def group(columns, records, **more):
    return {"items": [{"name": c} for c in columns], "itemData": records, **more}


@pytest.fixture
def documents(spark):
    def make(**docs):
        rows = [(k, d if isinstance(d, str) else json.dumps(d)) for k, d in docs.items()]
        return sl.DatasetJson(spark.createDataFrame(rows, "doc_id STRING, doc STRING"))

    return make


def by_document(findings, *columns):
    found = {}
    for r in findings.collect():
        found.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return {d: sorted(f) for d, f in found.items()}


def cls(name):
    return f"<class '{name}'>"


def test_top_level(documents):
    dj = documents(
        sound=with_groups({}),
        bare={"clinicalData": {"itemGroupData": {}}},
        null_attribute={"creationDateTime": None, "datasetJSONVersion": None, "referenceData": {"itemGroupData": {}}},
        rootless=HEAD,
        list_root={**HEAD, "clinicalData": []},
        full_list_root={**HEAD, "clinicalData": [1]},
        empty_root={**HEAD, "clinicalData": {}},
        empty_then_sound={**HEAD, "clinicalData": {}, "referenceData": {"itemGroupData": {}}},
        text_root={**HEAD, "clinicalData": "{}", "referenceData": {"itemGroupData": {}}},
        number_root={**HEAD, "clinicalData": 3},
        zero_root={**HEAD, "clinicalData": 0, "referenceData": False},
        no_groups={**HEAD, "clinicalData": {"x": 1}},
        list_groups={**HEAD, "clinicalData": {"itemGroupData": []}},
        null_groups={**HEAD, "clinicalData": {"itemGroupData": None}},
        real_groups={**HEAD, "referenceData": {"itemGroupData": 1.5}},
    )
    found = by_document(dj.validate_top_level(), "rule_id", "field", "evidence")
    root, groups = "clinicalData/referenceData", "itemGroupData"
    assert found == {
        "bare": [("DJ_000", "creationDateTime", ""), ("DJ_000", "datasetJSONVersion", "")],
        "rootless": [("DJ_001", root, "")],
        "list_root": [("DJ_002", root, cls("NoneType"))],
        "full_list_root": [("DJ_002", root, cls("list"))],
        "empty_root": [("DJ_002", root, cls("NoneType"))],
        "text_root": [("DJ_002", root, cls("str"))],
        "number_root": [("DJ_002", root, cls("int"))],
        "zero_root": [("DJ_002", root, cls("bool"))],
        "no_groups": [("DJ_003", groups, "")],
        "list_groups": [("DJ_004", groups, cls("list"))],
        "null_groups": [("DJ_004", groups, cls("NoneType"))],
        "real_groups": [("DJ_004", groups, cls("float"))],
    }
    messages = by_document(dj.validate_top_level(), "message")
    assert messages["bare"] == [f"Missing required top-level attribute: {k}" for k in HEAD]


def test_finding_type(documents, spark):
    dj = sl.DatasetJson(documents(rootless=HEAD).docs, finding_type="CUSTOM")
    (row,) = dj.validate_top_level().collect()
    assert (row.finding_type, row.severity, row.row_index, row.usubjid) == ("CUSTOM", "CRIT", -1, "")
    assert {r.finding_type for r in findings_of(dj.records(["DM"])).collect()} == {"CUSTOM"}


def test_item_group_as_table(documents):
    dj = documents(d=with_groups({"IG.LAB": group(["LBTEST", "LBORRES"], [["ALT", 31], ["AST", None], ["GGT", "12,5"]], name="LB")}))
    table = dj.itemgroup_table("IG.LAB")
    assert table.columns == ["doc_id", "row_index", "src_index", "LBTEST", "LBORRES"]
    assert sorted(map(tuple, table.collect())) == [("d", 0, 0, "ALT", "31"), ("d", 1, 1, "AST", None), ("d", 2, 2, "GGT", "12,5")]
    assert findings_of(dj.itemgroup_records(["IG.LAB"])).count() == 0
    assert by_document(dj.itemgroups(), "oids") == {"d": [["IG.LAB"]]}


def test_short_and_long_records(documents):
    dj = documents(d=with_groups({"IG.VS": group(["USUBJID", "VSTESTCD"], [["a"], ["b", "HR", "x"], ["c", "HR"]])}))
    assert sorted(map(tuple, dj.domain_table("VS").collect())) == [
        ("d", 0, 0, "a", None), ("d", 1, 1, "b", "HR"), ("d", 2, 2, "c", "HR"),
    ]
    found = by_document(findings_of(dj.records(["VS"])), "rule_id", "field", "row_index", "evidence")
    assert found == {
        "d": [
            ("DJ_106", "IG.VS.itemData[0]", 0, "len(record)=1 len(items)=2"),
            ("DJ_106", "IG.VS.itemData[1]", 1, "len(record)=3 len(items)=2"),
        ]
    }


def test_records_that_are_no_arrays(documents):
    records = [["a"], 5, "[1]", None, {"x": 1}, 1.5, True, ["b"], 12345678901234567890123]
    dj = documents(d=with_groups({"IG.DM": group(["U"], records)}), e=with_groups({"IG.DM": group(["U"], [["c"]])}))
    # Usable records are numbered on; findings keep the place in the document.
    assert sorted(map(tuple, dj.domain_table("DM").collect())) == [("d", 0, 0, "a"), ("d", 1, 7, "b"), ("e", 0, 0, "c")]
    found = by_document(findings_of(dj.records(["DM"])), "rule_id", "row_index", "evidence")
    kinds = {1: "int", 2: "str", 3: "NoneType", 4: "dict", 5: "float", 6: "bool", 8: "int"}
    assert found == {"d": [("DJ_105", i, cls(k)) for i, k in kinds.items()]}


def test_cell_values(documents):
    record = ["a", 1, 1.5, True, None, [1, "x"], {"k": None}, 'quote " and \n', "é"]
    columns = [f"C{i}" for i in range(len(record))]
    dj = documents(d=with_groups({"IG.DM": group(columns, [record])}))
    assert tuple(dj.domain_table("DM").first())[3:] == (
        "a", "1", "1.5", "true", None, '[1,"x"]', '{"k":null}', 'quote " and \n', "é",
    )


def test_column_names(documents):
    items = [{"name": "A", "OID": "x"}, {"OID": "B"}, {"name": "", "OID": None}, 7, {"name": "A"}, {"name": "A"}]
    dj = documents(d=with_groups({"IG.DM": {"items": items, "itemData": [list("abcdef")]}}))
    # The odd item drops a name but no value, so later values move one column to the left.
    assert dj.domain_table("DM").columns[3:] == ["A", "B", "COL_2", "A_2", "A_3"]
    assert tuple(dj.domain_table("DM").first())[3:] == tuple("abcde")
    found = by_document(findings_of(dj.records(["DM"])), "rule_id", "field", "evidence")
    assert found == {
        "d": [("DJ_103", "IG.DM.items[3]", cls("int")), ("DJ_106", "IG.DM.itemData[0]", "len(record)=6 len(items)=5")]
    }


def test_item_group_faults(documents):
    dj = documents(
        no_items=with_groups({"IG.DM": {"itemData": [["a"]]}}),
        empty_items=with_groups({"IG.DM": {"items": [], "itemData": [["a"]]}}),
        object_items=with_groups({"IG.DM": {"items": {"k": 1}, "itemData": [["a"]]}}),
        odd_items=with_groups({"IG.DM": {"items": [1, "x"], "itemData": [["a"]]}}),
        no_data=with_groups({"IG.DM": {"items": [{"name": "A"}]}}),
        object_data=with_groups({"IG.DM": {"items": [{"name": "A"}], "itemData": {"a": []}}}),
        number_group=with_groups({"IG.DM": 3, "IG.VS": {}}),
        absent=with_groups({"IG.VS": {}}),
    )
    loose = by_document(findings_of(dj.records(["DM"])), "rule_id", "field", "evidence")
    items, data = "IG.DM.items", "IG.DM.itemData"
    assert loose == {
        "no_items": [("DJ_101", items, ""), ("DJ_104", items, "")],
        "empty_items": [("DJ_101", items, ""), ("DJ_104", items, "")],
        "object_items": [("DJ_101", items, ""), ("DJ_103", f"{items}[0]", cls("str")), ("DJ_104", items, "")],
        "odd_items": [
            ("DJ_103", f"{items}[0]", cls("int")), ("DJ_103", f"{items}[1]", cls("str")), ("DJ_104", items, ""),
        ],
        "no_data": [("DJ_102", data, cls("NoneType"))],
        "object_data": [("DJ_102", data, cls("dict"))],
        "number_group": [("DJ_100", "itemGroupData", "IG.DM;IG.VS")],
        "absent": [("DJ_110", "domain", "IG.VS")],
    }
    strict = by_document(findings_of(dj.records(["DM"], strict=True)), "rule_id")
    assert strict["no_items"] == strict["object_items"] == ["DJ_101"]
    assert strict["odd_items"] == ["DJ_103", "DJ_103", "DJ_104"]
    assert strict["no_data"] == ["DJ_102"]
    named = by_document(findings_of(dj.itemgroup_records(["IG.QQ"])), "rule_id", "message")
    assert named["absent"] == [("DJ_100", "ItemGroup 'IG.QQ' not found in itemGroupData.")]
    (row,) = findings_of(dj.records([" dm "])).filter("doc_id = 'absent'").collect()
    assert row.message == "Could not infer itemGroup OID for domain ' dm '."


def test_a_text_that_holds_json_is_a_text(documents):
    sound = group(["A"], [["v"]])
    dj = documents(
        group=with_groups({"IG.DM": json.dumps(sound), "IG.VS": sound}),
        items=with_groups({"IG.DM": {**sound, "items": "[]"}}),
        data=with_groups({"IG.DM": {**sound, "itemData": json.dumps(sound["itemData"])}}),
        groups=with_groups(json.dumps({"IG.DM": sound})),
    )
    found = by_document(findings_of(dj.records(["DM"])), "rule_id", "field", "evidence")
    assert found == {
        "group": [("DJ_100", "itemGroupData", "IG.DM;IG.VS")],
        "items": [
            ("DJ_101", "IG.DM.items", ""), ("DJ_103", "IG.DM.items[0]", cls("str")), ("DJ_103", "IG.DM.items[1]", cls("str")),
            ("DJ_104", "IG.DM.items", ""),
        ],
        "data": [("DJ_102", "IG.DM.itemData", cls("str"))],
        "groups": [("DJ_004", "itemGroupData", cls("str")), ("DJ_110", "domain", "")],
    }
    assert dj.domain_table("VS").count() == 1 and dj.domain_table("DM", ["A"]).count() == 0


def test_names_that_count_as_missing(documents):
    names = [0, 0.0, False, None, "", [], {}, True, 7, 2.5, "0", "false", '"']
    dj = documents(
        oid=with_groups({"IG.DM": {"items": [{"name": n, "OID": f"O{i}"} for i, n in enumerate(names)], "itemData": [list(range(13))]}}),
        place=with_groups({"IG.DM": {"items": [{"name": n, "OID": 0} for n in names[:7]] + [3], "itemData": []}}),
    )
    got = {r.doc_id: r.item_names for r in dj.group_columns(["DM"]).collect()}
    assert got["oid"] == [*(f"O{i}" for i in range(7)), "True", "7", "2.5", "0", "false", '"']
    assert got["place"] == [f"COL_{i}" for i in range(7)]
    expected = [str(n.get("name") or n.get("OID") or "") for n in ({"name": n, "OID": f"O{i}"} for i, n in enumerate(names))]
    assert got["oid"] == expected


def test_unreadable_documents(documents, spark):
    text = json.dumps(with_groups({"IG.DM": group(["A"], [["v"]])}))
    broken = {
        "cut": text[:-1], "cut_in_text": text[: text.index("itemData") + 4], "more": text + " x", "two": text + text, "list": text + "," + text,
        "closed_twice": text + "}", "closed_as_list": text + "]", "empty": "", "blank": " \n", "quotes": text.replace('"', "'"), "bom": "\ufeff" + text,
        "marker": text + ',"end":"x"',
    }
    fine = {"sound": text, "spaced": f" \n{text}\n ", "number": "5", "nothing": "null", "array": "[1]"}
    dj = documents(**broken, **fine)
    found = by_document(dj.validate_top_level(), "rule_id")
    assert {d for d, rules in found.items() if rules == ["DJ_UNREADABLE"]} == set(broken)
    assert all(found[d] == ["DJ_000", "DJ_000", "DJ_001"] for d in ("number", "nothing", "array"))
    assert not {"sound", "spaced"} & set(found)
    assert {r.doc_id for r in dj.domain_table("DM").collect()} == {"sound", "spaced"}
    for r in dj.validate_top_level().filter("rule_id = 'DJ_UNREADABLE'").collect():
        assert r.evidence == broken[r.doc_id][:20] and r.severity == "CRIT" and r.field == "document"
        with pytest.raises(ValueError):
            json.loads(broken[r.doc_id])
    nothing = sl.DatasetJson(spark.createDataFrame([("n", None)], "doc_id STRING, doc STRING"))
    assert [(r.rule_id, r.evidence) for r in nothing.validate_top_level().collect()] == [("DJ_UNREADABLE", "None")]
    result = sl.validate_documents(dj.docs, ["DM"])
    assert {r.doc_id for r in result.findings.filter("rule_id = 'DJ_UNREADABLE'").collect()} == set(broken)


def test_domain_inference(documents):
    dj = documents(
        by_name=with_groups({"IG.DM": {"name": "QQ"}, "IG.X": {"name": "dm"}}),
        by_end=with_groups({"IG.ADM": {}, "IG.DM": {}}),
        by_part=with_groups({"x.dm.y": {}}),
        by_name_after_odd=with_groups({"IG.1": 5, "IG.2": {"name": "DM"}}),
        none=with_groups({"IG.VS": {}, "DMX": {}}),
        repeated='{"clinicalData":{"itemGroupData":{"IG.DM":{"name":"VS"},"A":{"name":"x"},"A":{"name":"DM"}}}}',
    )
    assert by_document(dj.itemgroup_oids(["DM"]), "oid") == {
        "by_name": ["IG.X"], "by_end": ["IG.ADM"], "by_part": ["x.dm.y"], "by_name_after_odd": ["IG.2"],
        "none": [None], "repeated": ["A"],
    }


def test_repeated_keys(documents):
    dj = documents(
        d='{"clinicalData":{"itemGroupData":{"IG.DM":{"items":[{"name":"OLD"}],"itemData":[["o"]]},'
        '"IG.DM":{"items":[{"name":"N"}],"items":[{"name":"NEW"}],"itemData":[["v"]]}}}}'
    )
    assert dj.domain_table("DM").columns[3:] == ["NEW"]
    assert tuple(dj.domain_table("DM").first())[3:] == ("v",)


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(with_groups({"IG.DM": group(["U"], [["x"]])}), indent=2))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps(with_groups({"IG.DM": group(["U"], [["y"], ["z"]])})))
    docs = sl.read_documents(spark, str(tmp_path))
    rows = sl.DatasetJson(docs).domain_table("DM").collect()
    assert sorted((r.doc_id.rsplit("/", 1)[-1], r.row_index, r.U) for r in rows) == [
        ("a.json", 0, "x"), ("b.json", 0, "y"), ("b.json", 1, "z"),
    ]


def full_document(**changes):
    groups = {
        "IG.CM": group(["CMTRT", "USUBJID", "CMSTDTC"], [["zinc", "q4", "2019-12-01"], ["iron", "q1", "2019-12-02"]], name="CM"),
        "IG.DM": group(["STUDYID", "USUBJID"], [["T7", "q1"], ["T7", "q2"], ["T7", "q3"]], name="DM"),
        "IG.AE": group(["AETERM", "USUBJID"], [["cough", "q2"]], name="AE"),
        "IG.VS": group(["VSDTC", "VSORRES", "VSTESTCD", "USUBJID"], [["2019-12-01", "71", "HR", "q3"]], name="VS"),
    }
    groups.update({f"IG.{k}": v for k, v in changes.items()})
    return with_groups({k: v for k, v in groups.items() if v is not None})


def test_whole_document(documents):
    result = sl.validate_documents(documents(d=full_document()).docs)
    assert list(result.datasets) == ["DM", "VS", "AE", "CM"]
    assert result.datasets["DM"].count() == 3
    assert result.datasets["VS"].columns[3:] == ["VSDTC", "VSORRES", "VSTESTCD", "USUBJID"]
    found = by_document(result.findings, "rule_id", "field", "row_index", "usubjid")
    assert found == {
        "d": [
            ("SDTM_AE_000", "AESTDTC", -1, ""),
            ("SDTM_VS_005", "VSORRESU", -1, ""),
            ("X_DMLINK_CM_001", "USUBJID", 0, "q4"),
        ]
    }
    messages = by_document(result.findings, "rule_id", "message")["d"]
    assert messages[0] == ("SDTM_AE_000", "Missing required columns for AE: ['AESTDTC']")


def test_missing_domain(documents):
    doc = with_groups({"IG.DM": group(["USUBJID"], [["q1"], ["q2"]], name="DM")})
    result = sl.validate_documents(documents(d=doc).docs, domains=["DM", "CM"])
    assert result.datasets["DM"].count() == 2
    assert result.datasets["CM"].count() == 0
    assert by_document(result.findings, "rule_id") == {"d": ["DJ_110"]}
    with pytest.raises(KeyError):
        result.datasets["AE"]


def test_documents_do_not_mix(documents):
    result = sl.validate_documents(
        documents(
            a=full_document(DM=group(["USUBJID"], [["s1"], ["s1"], [None]]), VS=None, AE=None, CM=None),
            b=full_document(DM=group(["USUBJID"], [["s1"]]), CM=group(["USUBJID", "CMTRT", "CMSTDTC"], [["s2", "x", "y"], [None, "x", "y"]])),
            c=full_document(DM=group(["USUBJID"], []), CM=group(["USUBJID", "CMTRT", "CMSTDTC"], [["s2", "x", "y"]])),
            d=full_document(DM=group(["STUDYID"], [[""]]), CM=group(["CMTRT"], [["x"]])),
        ).docs,
        domains=["DM", "CM"],
    )
    found = by_document(result.findings, "rule_id", "row_index")
    assert found == {
        "a": [("DJ_110", -1), ("SDTM_DM_001", 2), ("SDTM_DM_002", 0), ("SDTM_DM_002", 1)],
        # A null id is an orphan where DM has rows; without DM rows there is no link check.
        "b": [("SDTM_CM_002", 0), ("SDTM_CM_002", 1), ("X_DMLINK_CM_001", 0), ("X_DMLINK_CM_001", 1)],
        "c": [("SDTM_CM_002", 0)],
        "d": [("SDTM_CM_000", -1), ("SDTM_DM_001", -1), ("SDTM_DM_003", 0), ("X_DMLINK_CM_000", -1)],
    }


def test_domain_profile_and_repeats(documents):
    doc = full_document(DM=group(["USUBJID", "STUDYID", "SEX"], [["s", "x", "M"], ["s", "x", "Q"], ["", "x", "M"], ["", "x", "M"]]))
    found = by_document(
        sl.validate_documents(documents(d=doc).docs, ["DM"], dm_profile="domain", duplicates="repeat").findings,
        "rule_id", "row_index",
    )
    assert found == {"d": [("SDTM_DM_001", 2), ("SDTM_DM_001", 3), ("SDTM_DM_002", 1), ("SDTM_DM_003", 1)]}
    no_study = full_document(DM=group(["USUBJID"], [["s"], ["s"]]))
    found = sl.validate_documents(documents(d=no_study).docs, ["DM"], dm_profile="domain").findings.collect()
    assert [(r.rule_id, r.finding_type) for r in found] == [("SDTM_DM_000", "CROSS_DOMAIN")]


ABSENT = object()
ROOTS = [
    ABSENT, None, False, True, 0, 1, 0.0, -0.0, 1.5, 10**25, "", "x", "0", "false", "{}", "[]", [], [1], [[]], {}, {"x": 1},
    {"itemGroupData": None}, {"itemGroupData": {}}, {"itemGroupData": []}, {"itemGroupData": "s"}, {"itemGroupData": ""},
    {"itemGroupData": "{}"}, {"itemGroupData": '{"A":{}}'}, {"itemGroupData": 3}, {"itemGroupData": False}, {"itemGroupData": [{}]}, {"itemGroupData": {"A": 1}},
]


def expected_structure(clinical, reference):
    given = [v for v in (clinical, reference) if v is not ABSENT]
    if not given:
        return [("DJ_001", "")]
    value = clinical if clinical is not ABSENT and clinical else (None if reference is ABSENT else reference)
    if not isinstance(value, dict):
        return [("DJ_002", str(type(value)))]
    if "itemGroupData" not in value:
        return [("DJ_003", "")]
    groups = value["itemGroupData"]
    return [] if isinstance(groups, dict) else [("DJ_004", str(type(groups)))]


def test_every_pair_of_roots(documents):
    docs, expected = {}, {}
    for i, clinical in enumerate(ROOTS):
        for j, reference in enumerate(ROOTS):
            name = f"{i}/{j}"
            roots = {"clinicalData": clinical, "referenceData": reference}
            docs[name] = {**HEAD, **{k: v for k, v in roots.items() if v is not ABSENT}}
            if faults := expected_structure(clinical, reference):
                expected[name] = faults
    assert by_document(documents(**docs).validate_top_level(), "rule_id", "evidence") == expected


cells = st.one_of(st.none(), st.text(max_size=12), st.integers(-(10**6), 10**6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    tables=st.lists(
        st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(cells, min_size=n, max_size=n), min_size=1, max_size=6)),
        min_size=1, max_size=5,
    )
)
def test_round_trip(documents, tables):
    docs = {
        str(i): with_groups({"IG.DM": group([f"C{k}" for k in range(len(rows[0]))], rows)}) for i, rows in enumerate(tables)
    }
    dj = documents(**docs)
    columns = ["C0", "C1", "C2", "C3"]
    found = {(r.doc_id, r.row_index): [r[c] for c in columns] for r in dj.domain_table("DM", columns).collect()}
    assert found == {
        (str(i), n): [None if v is None else str(v) for v in [*row, None, None, None, None][:4]]
        for i, rows in enumerate(tables)
        for n, row in enumerate(rows)
    }
    assert findings_of(dj.records(["DM"])).count() == 0
