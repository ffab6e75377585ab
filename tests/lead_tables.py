"""Small lead tables for tests."""

import datetime as dt

from demandlens.operators.leads import EXTRA_TYPE

NOW = dt.datetime(2024, 1, 31, 12, 0)
LEAD_SCHEMA = f"""id long, place_id string, name string, address string, area string, city string, phone string, wa string, phone_type string,
website string, email string, instagram string, facebook string, rating double, reviews int, maps_url string, lat double, lng double,
source string, query string, seed string, signals array<struct<label:string,pts:int>>, extra {EXTRA_TYPE}, score int, stage string, lang string,
contact_name string, notes string, touches int, next_action string, next_followup timestamp, last_contacted timestamp, pilot_start timestamp,
lost_reason string, enriched timestamp, created timestamp, updated timestamp"""
BATCH_SCHEMA = """seq long, place_id string, name string, address string, area string, city string, phone string, intl_phone string, website string,
rating double, reviews int, maps_url string, status string, lat double, lng double"""


def columns(schema):
    out, depth, word = [], 0, ""
    for ch in schema.replace("\n", " "):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out + [word.split()[0]]


def lead_rows(spark, dicts):
    names = columns(LEAD_SCHEMA)
    base = {"touches": 0, "stage": "new", "lang": "en", "score": 0, "phone_type": "invalid"}
    for text in ("name address area city phone wa website email instagram facebook maps_url source query seed contact_name notes").split():
        base[text] = ""
    return spark.createDataFrame([tuple({**base, **d}.get(n) for n in names) for d in dicts], LEAD_SCHEMA)


def batch_rows(spark, dicts):
    names = columns(BATCH_SCHEMA)
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], BATCH_SCHEMA)
