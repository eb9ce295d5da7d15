import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.operators import atomic, normalize
from marlstone.plans import local_search, render
from marlstone.sources import criteria, listings
from tests.engine.builders import raw

HOST = "https://listings.fixture.example/offers/"


def record(i, **more):
    return {"publication_id": i, "url": f"{HOST}{i}", "observed_at": "2026-02-01T00:00:00Z"} | more


LISTINGS = [
    record("barge", observed_at="2025-11-30T18:45:00-06:30", location_text="East\tPier  no. 7 ß", price_major="7350.5", currency="RUB", total_area_sqm="18.30", rooms="studio"),
    record("loft", observed_at="2025-12-24T06:07:08.09Z", price_major="41200", currency="RUB", total_area_sqm="87.000", rooms="04", location_text="Mill Lane"),
    record("shed"),
    record("villa", observed_at="2025-12-01T00:00:00+14:00", price_major="999999.99", currency="EUR", total_area_sqm="310", rooms="9"),
    record("annex", observed_at="2025-12-24T06:07:08Z", price_major="41200.00", currency="RUB", rooms="4"),
]


def write(tmp_path, document, asked):
    a, b = tmp_path / "l.json", tmp_path / "c.json"
    a.write_text(document if isinstance(document, str) else json.dumps(document))
    b.write_text(asked if isinstance(asked, str) else json.dumps(asked))
    return a, b


def batch(records, **more):
    return {"schema_version": "fixture-source-batch@1", "source": "fixture_portal", "listings": records} | more


def ask(**criteria_):
    return {"schema_version": "search-criteria@1", "criteria": criteria_}


BOTH = ask(maximum_price={"amount_minor": 4120000, "currency": "RUB"}, allowed_rooms=[4, 0, 7])


@pytest.mark.parametrize(
    ("asked", "order"),
    [
        (ask(), ["barge", "annex", "loft", "shed", "villa"]),
        (BOTH, ["barge", "annex", "loft"]),
        (ask(maximum_price={"amount_minor": 4119999, "currency": "RUB"}), ["barge"]),
        (ask(minimum_total_area="87"), ["loft", "villa"]),
        (ask(minimum_total_area="87.01", allowed_rooms=[9]), ["villa"]),
        (ask(allowed_rooms=[1, 2, 3]), []),
    ],
)
def test_search_results(spark, tmp_path, asked, order):
    found = local_search.run(spark, *write(tmp_path, batch(LISTINGS), asked))
    assert found.issues == () and found.data.endswith(b"}\n") and found.data.isascii()
    document = json.loads(found.data)
    assert [m["publication_ref"]["value"]["publication_id"] for m in document["matches"]] == order
    assert found.data == json.dumps(document, separators=(",", ":"), sort_keys=True).encode() + b"\n"


def test_canonical_document(spark, tmp_path):
    document = json.loads(local_search.run(spark, *write(tmp_path, batch(LISTINGS), BOTH)).data)
    assert document["criteria"] == {"allowed_rooms": [0, 4, 7], "maximum_price": {"amount_minor": 4120000, "currency": "RUB"}}
    barge, annex, loft = document["matches"]
    assert set(barge) == {"currency", "location_text", "observed_at", "price_amount", "publication_ref", "rooms", "source_url", "total_area"}
    assert barge["location_text"]["value"] == "East Pier no. 7 ß"
    assert barge["observed_at"]["value"] == "2025-12-01T01:15:00.000000Z"
    assert loft["price_amount"] == {
        "provenance": {
            "input_path": "$.listings[1].price_major", "normalization_rule_version": "fixture-price-major@1", "observed_at": "2025-12-24T06:07:08.090000Z",
            "publication_id": "loft", "raw_value": "41200", "source_field": "price_major", "source_id": "fixture_portal",
        },
        "state": "present", "value": 4120000,
    }
    assert annex["total_area"]["state"] == "missing" and "raw_value" not in annex["total_area"]["provenance"] and "value" not in annex["total_area"]
    assert loft["total_area"]["value"] == "87.00" and barge["rooms"]["value"] == 0
    euro = json.loads(local_search.run(spark, *write(tmp_path, batch(LISTINGS), ask(allowed_rooms=[9]))).data)["matches"][0]["currency"]
    assert (euro["state"], euro["reason_code"], euro["provenance"]["raw_value"]) == ("unsupported", "unsupported_currency", "EUR") and "value" not in euro


def test_matches_that_break_the_contract(spark):
    rows = normalize.normalized(raw(spark, {"price_major": "1", "currency": "RUB", "total_area_sqm": "5", "rooms": "2", "location_text": "x"}))
    told = lambda df: df.select(render.breaks_contract().alias("bad")).first().bad
    assert not told(rows)
    field = lambda name, part, value: rows.withColumn(name, F.col(name).withField(part, F.lit(value)))
    for wrong in (
        field("rooms", "value", 100), field("price_amount", "value", 0), field("total_area", "value", -5), field("currency", "value", "EUR"), field("rooms", "input_path", "$.listings[9].rooms"),
        field("rooms", "state", "odd"), field("location_text", "raw_value", None), field("rooms", "rule_version", "a b"), rows.withColumn("publication_id", F.lit("a b")),
        rows.withColumn("observed_at", F.lit(None).cast("timestamp")),
    ):
        assert told(wrong)


@pytest.mark.parametrize(
    ("document", "issues"),
    [
        ('{"schema_version": ', ["INPUT_SYNTAX/invalid_json/$"]),
        ('{"a": NaN}', ["INPUT_SYNTAX/invalid_json/$"]),
        ("[]", ["INPUT_SCHEMA/wrong_type/$"]),
        ("{}", ["INPUT_SCHEMA/missing_field/$.listings", "INPUT_SCHEMA/missing_field/$.schema_version", "INPUT_SCHEMA/missing_field/$.source"]),
        (batch([]), ["INPUT_SCHEMA/invalid_value/$.listings"]),
        (batch({}), ["INPUT_SCHEMA/wrong_type/$.listings"]),
        (batch([record("a")], schema_version=3, source=None, more=1), ["INPUT_SCHEMA/extra_field/$.more", "INPUT_SCHEMA/unsupported_schema_version/$.schema_version", "INPUT_SCHEMA/wrong_type/$.source"]),
        (
            batch([{"publication_id": "s", "observed_at": "2026-02-01T00:00:00Z", "rooms": None, "extra_note": "x"}, {"publication_id": 42, "url": "u", "observed_at": 17}, 5]),
            ["INPUT_SCHEMA/extra_field/$.listings[0].extra_note", "INPUT_SCHEMA/wrong_type/$.listings[0].rooms", "INPUT_SCHEMA/missing_field/$.listings[0].url",
             "INPUT_SCHEMA/wrong_type/$.listings[1].observed_at", "INPUT_SCHEMA/wrong_type/$.listings[1].publication_id", "INPUT_SCHEMA/wrong_type/$.listings[2]"],
        ),
        (batch([record("a")], source="other"), ["SOURCE_ADAPTER/source_mismatch/$.source"]),
        (batch([record("a b")]), ["SOURCE_ADAPTER/inconsistent_record/$.listings[0].publication_id", "SOURCE_ADAPTER/invalid_source_url/$.listings[0].url"]),
        (batch([record("a", url=f"{HOST}b")]), ["SOURCE_ADAPTER/invalid_source_url/$.listings[0].url"]),
        (batch([record("a", total_area_sqm="1.001"), record("a", price_major="1")]), ["NORMALIZATION/precision_loss/$.listings[0].total_area_sqm", "NORMALIZATION/incomplete_money/$.listings[1]"]),
        (batch([record("a"), record("b"), record("a"), record("a")]), ["COLLECTION_CONFLICT/duplicate_publication_ref/$.listings[2]", "COLLECTION_CONFLICT/duplicate_publication_ref/$.listings[3]"]),
    ],
)
def test_diagnostics_are_complete_and_ordered(spark, tmp_path, document, issues):
    found = local_search.run(spark, *write(tmp_path, document, ask()))
    assert found.data is None
    assert [f"{c}/{code}/{p}" for _, _, p, c, code in found.issues] == issues


def test_issues_of_both_documents(spark, tmp_path):
    found = local_search.run(spark, *write(tmp_path, "{", ask(allowed_rooms=[])))
    assert [(x[0], x[4]) for x in found.issues] == [("listings", "invalid_json"), ("criteria", "invalid_criterion")]


@pytest.mark.parametrize(
    ("document", "issues"),
    [
        ("[1]", ["$ wrong_type"]),
        ({"schema_version": "search-criteria@2", "criteria": {}}, ["$.schema_version unsupported_schema_version"]),
        ({"schema_version": 1, "criteria": []}, ["$.criteria wrong_type", "$.schema_version wrong_type"]),
        (ask(maximum_price=None, minimum_total_area=None, allowed_rooms=None, x=1), ["$.criteria.allowed_rooms wrong_type", "$.criteria.maximum_price wrong_type", "$.criteria.minimum_total_area wrong_type", "$.criteria.x extra_field"]),
        (ask(maximum_price={"amount_minor": 0, "currency": "USD"}), ["$.criteria.maximum_price.amount_minor invalid_criterion", "$.criteria.maximum_price.currency invalid_criterion"]),
        (ask(maximum_price={"amount_minor": True}), ["$.criteria.maximum_price.amount_minor wrong_type", "$.criteria.maximum_price.currency missing_field"]),
        (ask(maximum_price={"amount_minor": 2**63, "currency": "RUB"}), ["$.criteria.maximum_price.amount_minor invalid_criterion"]),
        (ask(allowed_rooms=[1, 1, 100, 100, "2", True]), [f"$.criteria.allowed_rooms[{k}] {c}" for k, c in ((1, "invalid_criterion"), (2, "invalid_criterion"), (3, "invalid_criterion"), (4, "wrong_type"), (5, "wrong_type"))]),
        (ask(minimum_total_area="0"), ["$.criteria.minimum_total_area invalid_criterion"]),
        (ask(minimum_total_area="-1"), ["$.criteria.minimum_total_area invalid_criterion"]),
        (ask(minimum_total_area="1.001"), ["$.criteria.minimum_total_area invalid_criterion"]),
    ],
)
def test_criteria_diagnostics(document, issues):
    found, wrong = criteria.load(json.dumps(document))
    assert found is None and [f"{x[2]} {x[4]}" for x in wrong] == issues


def test_command_line(spark, tmp_path, capfdbinary):
    paths = write(tmp_path, batch(LISTINGS), BOTH)
    args = ["search", "--listings", str(paths[0]), "--criteria", str(paths[1])]
    assert cli.main(args, spark) == 0
    out = capfdbinary.readouterr().out
    assert json.loads(out[out.index(b"{") :])["schema_version"] == "search-result@1"
    paths[0].write_text("{")
    assert cli.main(args, spark) == 1
    assert b"INPUT_SYNTAX/invalid_json/$\n" in capfdbinary.readouterr().err
    paths[0].write_bytes(b"\xff")
    assert cli.main(args, spark) == 2
    assert b"listings/invalid_utf8\n" in capfdbinary.readouterr().err
    Path(paths[1]).unlink()
    paths[0].write_text("{}")
    assert cli.main(args, spark) == 2


def test_gate_and_many_documents(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(batch([record(f"p{k}-{n}") for n in range(2)])))
    result = listings.load(listings.read_documents(spark, f"{tmp_path}/*.json"))
    assert atomic.gate(result).count() == 6
    (tmp_path / "bad.json").write_text("[")
    with pytest.raises(atomic.Rejected) as e:
        atomic.gate(listings.load(listings.read_documents(spark, f"{tmp_path}/*.json")))
    assert e.value.conflicts.select(F.col("code")).first()[0] == "invalid_json"
