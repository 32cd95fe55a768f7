"""Jobs that reduce their inputs before joining them, against plain nested loops over small random tables.

The loops take the jobs literally: join everything, then group or pick. Tables hold NULLs, missing and
repeated keys.
"""

import datetime as dt
import random
from decimal import Decimal

import pytest

from regmart.operators import Period, hot_keys
from regmart.plans import (
    AdvertTables,
    advert_history_all,
    advert_history_of,
    advert_snapshots,
    contract_pairs,
    deal_listing,
    deal_rollup,
    document_rollup,
    object_rollup,
    price_steps,
)
from regmart.sources import SCHEMAS

D, TS = dt.date, dt.datetime
SEEDS = [1, 2, 3]


@pytest.fixture(autouse=True)
def spread(request, monkeypatch):
    """All seeds but the first run as if every key held in two rows were very frequent and every key list very long."""
    if request.getfixturevalue("seed") != 1:
        monkeypatch.setattr(hot_keys, "__defaults__", (2, 1000, 3))
        monkeypatch.setattr("regmart.operators.keys.fits_broadcast", lambda df, max_bytes=0: False)


class Tables:
    """Random rows of register tables, as DataFrames and as dicts."""

    def __init__(self, spark, seed):
        self.spark, self.rng = spark, random.Random(seed)

    def make(self, name, count, nulls=0.08, unique=(), **domains):
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        data = []
        for i in range(count):
            row = {}
            for field in schema.fields:
                c = field.name
                if c in unique:
                    row[c] = f"{c}{i}" if field.dataType.simpleString() == "string" else i
                elif c in domains:
                    row[c] = None if self.rng.random() < nulls else self.rng.choice(domains[c])
                else:
                    row[c] = self._any(field.dataType.simpleString())
            data.append(row)
        return self.spark.createDataFrame([tuple(r.values()) for r in data], schema), data

    def _any(self, kind):
        n = self.rng.randint(0, 3)
        if kind.startswith("decimal"):
            return Decimal(n)
        return {"string": f"t{n}", "bigint": n, "int": n, "double": float(n), "boolean": n == 0, "date": D(2022, 1, 1 + n),
                "timestamp": TS(2022, 1, 1 + n)}[kind]


def eq(a, b):
    return a is not None and b is not None and a == b


def left(rows, others, match):
    """Left join of tuples with dicts: unmatched tuples get an empty dict."""
    out = []
    for r in rows:
        found = [o for o in others if match(r, o)]
        out += [(*r, o) for o in found] or [(*r, {})]
    return out


def inner(rows, others, match):
    return [(*r, o) for r in rows for o in others if match(r, o)]


def texts(values):
    """Sorted distinct texts, joined."""
    found = sorted({str(v) for v in values if v is not None})
    return ",".join(found) if found else None


def largest(values):
    return max((v for v in values if v is not None), default=None)


def smallest(values):
    return min((v for v in values if v is not None), default=None)


def group(rows, key):
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    return groups


def up(*values):
    """Sort key: ascending, NULLs last."""
    return tuple((v is None, v if v is not None else 0) for v in values)


def key(row):
    return [(v is None, str(v)) for v in row]


def same(df, expected, columns):
    actual = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert actual == sorted(expected, key=key)
    assert actual, "the random tables should give some rows"


B = ["b0", "b1", "b2", "b3", "b4"]


@pytest.mark.parametrize("seed", SEEDS)
def test_object_rollup(spark, seed):
    t = Tables(spark, seed)
    decls = ["d0", "d1", "d2"]
    nums = ["46:29", "", "64:48 ", "52:26", "23:37"]
    lands, L = t.make("object_land_actual", 40, object_bkh=B, project_declaration_bkh=decls, cadastral_num=nums)
    prepared, P = t.make("project_declaration_prepared_actual", 4, project_declaration_prepared_bkh=decls[:2])
    decl, O = t.make("project_declaration_object_actual", 25, project_declaration_bkh=decls, object_bkh=B,
                     floor_max_cnt=[1, 5, 9], floor_min_cnt=[1, 2], total_area_amt=[Decimal(1), Decimal(7)])
    objects, C = t.make("object_actual", 6, bkh=B, src_object_id=[1, 2, 3], object_id=[1, 2], title_name=["x", "y"])
    addresses, A = t.make("object_address_actual", 8, object_bkh=B, house_num=["1", "2", "2a"])
    keys = ["46:29", "64:48", ""]

    base = inner([(x,) for x in L], P, lambda r, p: eq(p["project_declaration_prepared_bkh"], r[0]["project_declaration_bkh"]))
    base = inner(base, O, lambda r, o: eq(o["project_declaration_bkh"], r[0]["project_declaration_bkh"]) and eq(o["object_bkh"], r[0]["object_bkh"]))
    base = inner(base, C, lambda r, c: eq(c["bkh"], r[0]["object_bkh"]))
    wanted = {r[3]["src_object_id"] for r in base if r[0]["cadastral_num"] in keys} - {None}
    full = left([r for r in base if r[3]["src_object_id"] in wanted], A, lambda r, a: eq(a["object_bkh"], r[3]["bkh"]))
    expected = [
        (*k, texts(r[0]["cadastral_num"] for r in g), texts(r[3]["title_name"] for r in g),
         largest(r[2]["total_area_amt"] for r in g), largest(r[2]["living_area_amt"] for r in g),
         largest(r[2]["floor_max_cnt"] for r in g), smallest(r[2]["floor_min_cnt"] for r in g),
         texts(r[3]["full_address_txt"] for r in g), texts(r[4].get("house_num") for r in g))
        for k, g in group(full, lambda r: (r[3]["src_object_id"], r[3]["object_id"])).items()
    ]
    found = object_rollup(lands, prepared, decl, objects, addresses, keys)
    same(found, expected, found.columns)


@pytest.mark.parametrize("seed", SEEDS)
def test_document_rollup(spark, seed):
    t = Tables(spark, seed)
    decls, file_bkh, type_bkh = ["d0", "d1"], ["f0", "f1", "f2", "f3"], ["t0", "t1", "t2"]
    files, F_ = t.make("file_actual", 8, bkh=file_bkh, file_type_bkh=type_bkh, file_id=[1, 2, 3])
    file_types, FT = t.make("dct_file_type_actual", 6, bkh=type_bkh, file_type_code=["10 ", "10", "10 "])
    rel_files, RF = t.make("rel_document_file_actual", 25, document_bkh=B, file_bkh=file_bkh)
    docs, DO = t.make("document_actual", 9, bkh=B, document_id=[1, 2, 3], document_type_bkh=type_bkh, document_num=["n"])
    doc_types, DT = t.make("dct_document_type_actual", 6, bkh=type_bkh, document_type_code=["4", "4", "5"])
    rel_objects, RO = t.make("rel_document_object_actual", 25, document_bkh=B, src_object_id=[1, 2, 3])
    objects, OB = t.make("object_actual", 5, bkh=B, src_object_id=[1, 2, 3])
    lands, L = t.make("object_land_actual", 20, object_bkh=B, project_declaration_bkh=decls, cadastral_num=["a", "b", "c"])
    prepared, P = t.make("project_declaration_prepared_actual", 4, project_declaration_prepared_bkh=decls)

    about = inner([(d,) for d in DO], DT, lambda r, x: eq(x["bkh"], r[0]["document_type_bkh"]) and x["document_type_code"] == "4")
    about = inner(about, RO, lambda r, x: eq(x["document_bkh"], r[0]["bkh"]))
    about = inner(about, OB, lambda r, x: eq(x["src_object_id"], r[2]["src_object_id"]))
    wanted = {r[0]["document_id"] for r in about if r[3]["src_object_id"] in (1, 3)} - {None}
    full = inner([r for r in about if r[0]["document_id"] in wanted], RF, lambda r, x: eq(x["document_bkh"], r[0]["bkh"]))
    full = inner(full, F_, lambda r, x: eq(x["bkh"], r[4]["file_bkh"]))
    full = inner(full, FT, lambda r, x: eq(x["bkh"], r[5]["file_type_bkh"]) and x["file_type_code"] == "10 ")
    full = inner(full, L, lambda r, x: eq(x["object_bkh"], r[3]["bkh"]))
    full = inner(full, P, lambda r, x: eq(x["project_declaration_prepared_bkh"], r[7]["project_declaration_bkh"]))
    groups = group(full, lambda r: (r[0]["document_id"], r[0]["document_num"], r[0]["document_issue_date"], r[5]["file_id"],
                                    r[5]["file_original_name"], r[5]["file_url_txt"]))
    expected = [(*k, texts(r[7]["cadastral_num"] for r in g), texts(r[3]["src_object_id"] for r in g)) for k, g in groups.items()]
    keys = [1, 3] if seed < 3 else spark.createDataFrame([(1,), (3,), (3,), (None,)], "id int")
    found = document_rollup(files, file_types, rel_files, docs, doc_types, rel_objects, objects, lands, prepared, keys)
    same(found, expected, ["document_id", "document_num", "document_date", "file_id", "file_name", "file_link",
                           "cadastral_num", "oks_xml_id"])


@pytest.mark.parametrize("seed", SEEDS)
def test_contract_pairs(spark, seed):
    t = Tables(spark, seed)
    codes = ["p0", "p1", "p2", "p3"]
    entities, E = t.make("legal_entity_actual", 10, spark_id=[1, 2, 3, 4], inn=["i1", "i2"], kpp=["k1", "k2"])
    participants, P = t.make("state_contract_participant_actual", 40, spark_id=[1, 2, 3, 4], contract_code=["c1", "c2", "c3"],
                             contract_participant_code=codes, state_contract_role_code=["1", "2", "3"])
    dictionary, DI = t.make("dct_contract_participant_actual", 14, code=codes, participant_spark_id=[1, 2, 3, 9],
                            participant_inn_code=["i1", "i2"])
    contracts, C = t.make("state_contract_actual", 6, code=["c1", "c2", "c3"])
    companies = [e for e in E if (e["inn"], e["kpp"]) in {("i1", "k1"), ("i2", "k2")}]
    own = {e["spark_id"] for e in companies} - {None}
    S = [p for p in P if p["spark_id"] in own]
    full = inner([(a,) for a in companies], S, lambda r, b: eq(r[0]["spark_id"], b["spark_id"]) and b["state_contract_role_code"] == "2")
    full = inner(full, DI, lambda r, d: eq(r[0]["inn"], d["participant_inn_code"]) and eq(r[1]["contract_participant_code"], d["code"]))
    full = inner(full, S, lambda r, b: eq(r[1]["contract_code"], b["contract_code"]) and b["state_contract_role_code"] == "1")
    full = inner(full, DI, lambda r, d: eq(r[3]["contract_participant_code"], d["code"]))
    full = left(full, E, lambda r, e: eq(r[4]["participant_spark_id"], e["spark_id"]))
    full = inner(full, C, lambda r, c: eq(r[1]["contract_code"], c["code"]))
    expected = [(r[0]["inn"], r[0]["ogrn"], r[0]["kpp"], r[4]["participant_inn_code"], r[4]["participant_ogrn_code"], r[5].get("kpp"),
                 r[5].get("full_name_rus"), r[4]["participant_name"], r[6]["contract_date"], r[6]["contract_sum"]) for r in full]
    found = contract_pairs(entities, participants, dictionary, contracts, [("i1", "k1"), ("i2", "k2")])
    same(found, expected, ["inn", "ogrn", "kpp", "customer_inn", "customer_ogrn", "customer_kpp", "full_name_rus", "short_name_rus",
                           "contract_date", "contract_sum"])


def week(day):
    day += dt.timedelta(days=1)
    return f"{day.year:04d}-{(day.timetuple().tm_yday - 1) // 7 + 1:02d}"


@pytest.mark.parametrize("seed", SEEDS)
def test_deal_rollup_with_addresses_joined(spark, seed):
    t = Tables(spark, seed)
    homes = ["r0", "r1", "r2"]
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 12, 31), D(2021, 3, 3)]
    subjects = ["Квартира 1", "участок", "доля"]
    deals, DE = t.make("deal_actual", 25, unique=("bkh",), realty_bkh=homes, registration_date=days, region_code=["77", "50"],
                       deal_num=["n1", "n2", "n3"], subject_description=subjects, cancel_date=[D(2022, 1, 1)],
                       deal_condition_txt=["эскроу", "Escrow acc", "нет"], deal_price_amt=[Decimal(5), Decimal(6)])
    ids = [d["bkh"] for d in DE]
    docs, DO = t.make("cadastral_doc_actual", 40, reference_bkh=ids, cadastral_doc_type_bkh=["T", "T", "U"], cadastral_doc_addition_txt=["x", "y"])
    realty, R = t.make("realty_actual", 4, bkh=homes, cadastral_num=["77:1", "77:2"])
    shares, S = t.make("share_subject_description_actual", 30, 0.3, reference_bkh=ids, ods_description=["Квартира 1", "доля", "1/2"])
    _, A = t.make("realty_address_actual", 6, realty_bkh=homes, realty_region_bkh=["g0", "g1"])
    _, G = t.make("dct_region_actual", 3, bkh=["g0", "g1"])

    full = inner([(d,) for d in DE if d["registration_date"] and d["registration_date"] > D(2020, 1, 1)], DO,
                 lambda r, x: eq(r[0]["bkh"], x["reference_bkh"]) and x["cadastral_doc_type_bkh"] == "T")
    full = left(full, R, lambda r, x: eq(x["bkh"], r[0]["realty_bkh"]))
    full = left(full, S, lambda r, x: eq(x["reference_bkh"], r[0]["bkh"]))
    full = left(full, A, lambda r, x: eq(x["realty_bkh"], r[2].get("bkh")))
    full = left(full, G, lambda r, x: eq(x["bkh"], r[4].get("realty_region_bkh")))
    flat = []
    for d, doc, home, share, *_ in full:
        ods, subject, terms = share.get("ods_description"), d["subject_description"], (d["deal_condition_txt"] or "").upper()
        flat.append({
            "cad": home.get("cadastral_num"), "reg": d["registration_date"], "cancel": d["cancel_date"], "region": d["region_code"],
            "num": d["deal_num"], "doc": doc["cadastral_doc_addition_txt"], "price": d["deal_price_amt"], "subject": subject,
            "ods": ods if ods is not None else subject, "null": int(ods is None), "living": int("КВАРТИР" in (subject or "").upper()),
            "escrow": int(any(w in terms for w in ("ЭСКРОУ", "ЭКСРОУ", "ESCROW"))), "week": week(d["registration_date"]),
            "tie": (d["bkh"], doc["bkh"], share.get("bkh")),
        })
    weekly = [min(g, key=lambda r: up(r["cad"], r["num"], r["doc"], *r["tie"], r["null"]))
              for g in group(flat, lambda r: (r["ods"], r["region"], r["week"])).values()]
    nine = ("cad", "region", "reg", "cancel", "num", "subject", "living", "escrow", "doc")
    deal = []
    for k, g in group(weekly, lambda r: tuple(r[c] for c in nine)).items():
        descriptions = sorted((r["ods"] for r in g), key=lambda v: (v is not None, v or ""))
        deal.append({**dict(zip(nine, k)), "price": largest(r["price"] for r in g), "all": descriptions, "n": len(g),
                     "nulls": sum(r["null"] for r in g)})
    per_doc = [min(g, key=lambda r: up(r["region"], r["cancel"], r["num"], r["subject"], r["living"], r["escrow"]))
               for g in group(deal, lambda r: (r["doc"], r["cad"], r["reg"])).values()]
    last = [min(g, key=lambda r: up(r["cad"], r["reg"], r["doc"], r["region"], r["cancel"], r["subject"], r["living"], r["escrow"]))
            for g in group(per_doc, lambda r: r["num"]).values()]
    expected = [(r["all"], r["doc"], r["cad"], r["cancel"], r["n"], r["num"], r["price"], r["escrow"], r["living"], r["region"], r["reg"],
                 r["subject"], r["nulls"]) for r in last]
    found = deal_rollup(deals, docs, realty, shares, doc_type="T")
    same(found, expected, found.columns)


@pytest.mark.parametrize("seed", SEEDS)
def test_deal_listing(spark, seed):
    t = Tables(spark, seed)
    homes = ["r0", "r1", "r2"]
    realty, R = t.make("realty_actual", 4, bkh=homes)
    deals, DE = t.make("deal_actual", 12, bkh=B, realty_bkh=homes, registration_date=[D(2020, 12, 31), D(2021, 1, 1), D(2022, 5, 5)])
    docs, DO = t.make("cadastral_doc_actual", 14, reference_bkh=B, cadastral_doc_type_bkh=["t0", "t1", "t2"])
    types, TY = t.make("dct_cadastral_doc_type_actual", 4, bkh=["t0", "t1", "t2"], cadastral_doc_type_code=["558401010201", "7"])
    shares, S = t.make("share_subject_description_actual", 7, reference_bkh=B)
    addresses, A = t.make("realty_address_actual", 7, 0.15, realty_bkh=homes, realty_region_bkh=["g0", "g1", "g2"])
    regions, G = t.make("dct_region_actual", 4, bkh=["g0", "g1"])
    full = inner([(x,) for x in R], DE, lambda r, d: eq(r[0]["bkh"], d["realty_bkh"]) and (d["registration_date"] or D(1, 1, 1)).year >= 2021)
    full = inner(full, DO, lambda r, x: eq(x["reference_bkh"], r[1]["bkh"]))
    full = inner(full, TY, lambda r, x: eq(x["bkh"], r[2]["cadastral_doc_type_bkh"]) and x["cadastral_doc_type_code"] == "558401010201")
    full = left(full, S, lambda r, x: eq(x["reference_bkh"], r[1]["bkh"]))
    full = left(full, A, lambda r, x: eq(x["realty_bkh"], r[0]["bkh"]))
    full = left(full, G, lambda r, x: eq(x["bkh"], r[5].get("realty_region_bkh")))
    day = D(2022, 7, 1)
    expected = [(r[0]["bkh"], r[1]["bkh"], r[4].get("bkh"), r[0]["cadastral_num"], r[2]["cadastral_doc_num"], r[1]["registration_date"],
                 r[4].get("ods_description"), r[4].get("transfer_deadline_txt"), r[0]["room_area_amt"], day) for r in full]
    found = deal_listing(realty, deals, docs, types, shares, addresses, regions, as_of=day)
    same(found, expected, ["realty_bkh", "deal_bkh", "ods_bkh", "cadastral_num", "cadastral_doc_num", "registration_date",
                           "ods_description", "transfer_deadline_txt", "room_area_amt", "create_dt"])


AGENCY = ["Банк ДОМ.РФ", "ДОМ.РФ", "другое"]
ADS = [1, 2, 3, 4]


def advert_inputs(spark, seed):
    t = Tables(spark, seed)
    records, agents, states, cats, kinds = B, ["a0", "a1", "a2"], ["s0", "s1"], ["c0", "c1"], ["k0"]
    times = [TS(2022, 1, d) for d in (1, 2, 3)]
    realties = [1, 2, 3]
    made = {
        "adverts": t.make("advert", 40, unique=("advert_id",), bkh=records, src_cian_id=ADS, src_realty_id=realties, realty_agency_bkh=agents,
                          status_bkh=states, price_amt=[Decimal(5), Decimal(6)], valid_from=times, deleted_flag=[False, False, False, True]),
        "statistics": t.make("advert_statistic", 16, advert_bkh=records, valid_from=times, src_update_date=[TS(2022, 2, d) for d in (1, 2, 3)],
                             deleted_flag=[False, False, True]),
        "agencies": t.make("dct_realty_agency", 4, bkh=agents, realty_agency_name=AGENCY, deleted_flag=[False, False, True]),
        "statuses": t.make("dct_status", 4, bkh=states, status_name=["активно", "снято"]),
        "actual": t.make("advert_actual", 9, bkh=records, src_cian_id=ADS, src_realty_id=realties, realty_agency_bkh=agents, status_bkh=states,
                         advert_category_bkh=cats, building_type_bkh=kinds, user_address_txt=["street"]),
        "actual_statistics": t.make("advert_statistic_actual", 8, 0.2, advert_bkh=records, src_update_date=[TS(2022, 3, d) for d in (1, 2)],
                                    src_upload_date=[TS(2022, 3, d) for d in (1, 2)]),
        "actual_agencies": t.make("dct_realty_agency_actual", 4, bkh=agents, realty_agency_name=AGENCY),
        "actual_statuses": t.make("dct_status_actual", 3, bkh=states, status_name=["активно", "снято"]),
        "categories": t.make("dct_advert_category_actual", 3, bkh=cats),
        "actual_addresses": t.make("address_actual", 4, 0.2, src_realty_id=realties, user_address_txt=["there"]),
        "building_types": t.make("dct_building_type_actual", 2, bkh=kinds),
        "addresses": t.make("address", 6, src_realty_id=realties, user_address_txt=["old", "older"], deleted_flag=[False, True]),
    }
    return AdvertTables(**{k: v[0] for k, v in made.items()}), {k: v[1] for k, v in made.items()}


def naive_versions(d, with_address):
    good = AGENCY[:2]
    full = inner([(a,) for a in d["adverts"] if a["deleted_flag"] is False], d["statistics"],
                 lambda r, s: s["deleted_flag"] is False and eq(s["advert_bkh"], r[0]["bkh"]) and eq(s["valid_from"], r[0]["valid_from"]))
    full = inner(full, d["agencies"],
                 lambda r, g: eq(g["bkh"], r[0]["realty_agency_bkh"]) and g["deleted_flag"] is False and g["realty_agency_name"] in good)
    full = inner(full, d["statuses"], lambda r, s: eq(s["bkh"], r[0]["status_bkh"]))
    if with_address:
        full = left(full, d["addresses"], lambda r, x: x["deleted_flag"] is False and eq(x["src_realty_id"], r[0]["src_realty_id"]))
    else:
        full = [(*r, {}) for r in full]
    return [
        {"id": a["src_cian_id"], "advert_id": a["advert_id"], "agency": g["realty_agency_name"], "price": a["price_amt"], "bkh": a["bkh"],
         "at": s["src_update_date"], "start": a["valid_from"], "status": st["status_name"], "address": ad.get("user_address_txt")}
        for a, s, g, st, ad in full
    ]


def naive_history(d, with_address, only=None):
    versions = naive_versions(d, with_address)
    changed = {i for i, g in group(versions, lambda v: v["id"]).items() if i is not None and len({v["price"] for v in g} - {None}) > 1}
    last = {i: largest(v["at"] for v in g) for i, g in group(versions, lambda v: v["id"]).items()}
    listed = inner([(a,) for a in d["actual"]], d["actual_statistics"], lambda r, s: eq(s["advert_bkh"], r[0]["bkh"]))
    listed = inner(listed, d["actual_agencies"], lambda r, g: eq(g["bkh"], r[0]["realty_agency_bkh"]) and g["realty_agency_name"] in AGENCY[:2])
    best = []
    for g in group(listed, lambda r: r[0]["src_cian_id"]).values():
        def newest_first(r):
            return tuple((v is not None, -(v or TS(2000, 1, 1)).timestamp()) for v in (r[1]["src_update_date"], r[1]["src_upload_date"]))
        first = min(map(newest_first, g))
        best += [r[0]["bkh"] for r in g if newest_first(r) == first]
    full = [(a,) for a in d["actual"] for b in best if eq(a["bkh"], b) and (only is None or a["src_cian_id"] in only)]
    full = left(full, versions, lambda r, v: eq(v["id"], r[0]["src_cian_id"]))
    full = inner(full, d["actual_statuses"], lambda r, s: eq(s["bkh"], r[0]["status_bkh"]))
    full = inner(full, d["categories"], lambda r, c: eq(c["bkh"], r[0]["advert_category_bkh"]))
    full = left(full, d["actual_statistics"], lambda r, s: eq(s["advert_bkh"], r[0]["bkh"]))
    full = left(full, d["actual_addresses"], lambda r, x: eq(x["src_realty_id"], r[0]["src_realty_id"]))
    full = left(full, d["building_types"], lambda r, b: eq(b["bkh"], r[0]["building_type_bkh"]))
    out = []
    for a, v, st, c, s, ad, b in full:
        end = D(2022, 7, 1) if st["status_name"] == "активно" else v["at"].date() if v.get("at") else None
        out.append({
            "src_cian_id": v.get("id"), "advert_id": v.get("advert_id"), "bkh": v.get("bkh"), "price_amt": v.get("price"), "valid_from": v.get("at"),
            "last_valid_from": last[v["id"]] if v else None, "historic_status": v.get("status"), "historic_address": v.get("address"),
            "srok": (end - a["create_date"]).days if end else None, "status_name": st["status_name"], "actual_price_amt": a["price_amt"],
            "advert_category_name": c["advert_category_name"], "view_cnt": s.get("view_cnt"), "region_name": ad.get("region_name"),
            "user_address_txt": ad.get("user_address_txt"), "user_address_txt2": a["user_address_txt"],
            "building_type_name": b.get("building_type_name"), "change_price": "Да" if a["src_cian_id"] in changed else "Нет",
        })
    return out


COMMON = ["src_cian_id", "bkh", "price_amt", "valid_from", "last_valid_from", "historic_status", "srok", "status_name", "actual_price_amt",
          "advert_category_name", "view_cnt", "region_name", "building_type_name", "change_price"]


@pytest.mark.parametrize("seed", SEEDS)
def test_advert_history(spark, tmp_path, seed):
    tables, data = advert_inputs(spark, seed)
    day = D(2022, 7, 1)

    every = advert_history_all(tables, as_of=day)
    cols = [*COMMON, "advert_id", "user_address_txt", "user_address_txt2"]
    expected = [tuple({**r, "user_address_txt": r["user_address_txt"] or "(пусто)", "user_address_txt2": r["user_address_txt2"] or "(пусто)"}[c]
                      for c in cols) for r in naive_history(data, False)]
    same(every, expected, cols)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    same(advert_history_all(tables, as_of=day, stage=lambda df: df.checkpoint()), expected, cols)

    keys = [1, 2, 3] if seed < 3 else spark.createDataFrame([(i,) for i in (1, 2, 2, 3, None)], "id bigint")
    some = advert_history_of(tables, keys, as_of=day)
    cols = [*COMMON, "historic_address", "user_address_txt"]
    same(some, [tuple(r[c] for c in cols) for r in naive_history(data, True, {1, 2, 3})], cols)


@pytest.mark.parametrize("seed", SEEDS)
def test_price_steps(spark, seed):
    tables, data = advert_inputs(spark, seed)
    versions = naive_versions(data, False)
    steps = price_steps(tables).collect()
    assert len(steps) == len(versions)
    listed = group(versions, lambda v: v["id"])
    for advert, rows in group(steps, lambda r: r.src_cian_id).items():
        starts = sorted((v["start"] for v in listed[advert]), key=lambda x: (x is None, x))
        # every row stands at one place of the advert's versions: its neighbours are the starts around that place
        around = lambda x: sorted(map(str, x))
        places = [(starts[i - 1] if i else None, starts[i + 1] if i + 1 < len(starts) else None) for i in range(len(starts))]
        assert around((r.prev_valid_date, r.next_valid_date) for r in rows) == around(places)
        for r in rows:
            own = [v["start"] for v in listed[advert] if (v["advert_id"], v["bkh"], v["at"]) == (r.advert_id, r.bkh, r.valid_from)]
            assert any((r.prev_valid_date, r.next_valid_date) == p for s, p in zip(starts, places) if s in own)
            days = None if None in (r.valid_from, r.next_valid_date) else (r.valid_from.date() - r.next_valid_date.date()).days
            assert r.days_to_next == ("Новое объявление" if days is None else str(days))


@pytest.mark.parametrize("seed", SEEDS)
def test_advert_snapshots(spark, seed):
    t = Tables(spark, seed)
    days = [TS(2022, 5, 1), TS(2022, 5, 31, 23, 59), TS(2022, 6, 1), TS(2022, 6, 30, 23, 59, 59), TS(2022, 6, 30, 23, 59, 59, 500000)]
    adverts, A = t.make("advert", 60, src_cian_id=ADS, src_realty_id=[1, 2, 3], status_bkh=["s0", "s1"], advert_category_bkh=["c0", "c1", "c2"],
                        housing_complex_block_code=["h0", "h1", "h2"], valid_from=days, deleted_flag=[False, False, True])
    statuses, S = t.make("dct_status_actual", 4, bkh=["s0", "s1"], status_code=[1, 1, 2])
    addresses, L = t.make("address_actual", 5, src_realty_id=[1, 2, 3], region_name=["Москва", "Москва", "Тверь"])
    categories, C = t.make("dct_advert_category_actual", 4, bkh=["c0", "c1"], advert_category_code=["x", "y"], advert_category_name=["n", "m"])
    blocks, H = t.make("dct_housing_complex_block_actual", 4, housing_complex_block_code=["h0", "h1"], building_class_bkh=["k0", "k1"])
    classes, K = t.make("dct_building_class_actual", 3, bkh=["k0", "k1"])

    full = left([(a,) for a in A if a["deleted_flag"] is False], C, lambda r, c: eq(c["bkh"], r[0]["advert_category_bkh"]))
    full = [r for r in left(full, S, lambda r, s: eq(s["bkh"], r[0]["status_bkh"])) if r[2].get("status_code") == 1]
    full = [r for r in left(full, L, lambda r, x: eq(x["src_realty_id"], r[0]["src_realty_id"])) if r[3].get("region_name") == "Москва"]
    full = left(full, H, lambda r, h: eq(h["housing_complex_block_code"], r[0]["housing_complex_block_code"]))
    full = left(full, K, lambda r, k: eq(k["bkh"], r[4].get("building_class_bkh")))
    measures = ["price_sqm_amt", "price_amt", "currency_name", "realty_latitude", "realty_longitude", "room_cnt", "total_area_amt"]
    expected = []
    inside = {
        "before": lambda x: x < TS(2022, 6, 1),
        "within": lambda x: TS(2022, 6, 1) <= x <= TS(2022, 6, 30, 23, 59, 59),
    }
    for label, test in inside.items():
        rows = [r for r in full if r[0]["valid_from"] is not None and test(r[0]["valid_from"])]
        for i, g in group(rows, lambda r: r[0]["src_cian_id"]).items():
            def rank(r):
                a = r[0]
                return (-a["valid_from"].timestamp(), up(*[a[m] for m in measures], a["advert_category_bkh"], a["housing_complex_block_code"]),
                        up(r[1].get("advert_category_code"), r[1].get("advert_category_name")),
                        up(r[5].get("building_class_type"), r[5].get("building_class_name")))
            a, c, _, _, _, k = min(g, key=rank)
            expected.append((label, i, "Москва", *[a[m] for m in measures], c.get("advert_category_code"), c.get("advert_category_name"),
                             k.get("building_class_type"), k.get("building_class_name")))
    found = advert_snapshots(adverts, statuses, addresses, categories, blocks, classes)
    same(found, expected, found.columns)
    assert found.count() == sum(
        advert_snapshots(adverts, statuses, addresses, categories, blocks, classes, [p]).count()
        for p in (Period("before", end=TS(2022, 6, 1)), Period("within", TS(2022, 6, 1), TS(2022, 6, 30, 23, 59, 59), closed=True))
    )
