"""Domain types: how a column's name, description and values give its meaning away, and what its values must look like."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Domains, with words in names, words in descriptions, and forms of values.
DOMAINS: dict[str, dict] = {
    "us_state_code": {"names": ("state", "state_code", "st"), "words": ("state",), "regex": r"[A-Z]{2}$", "length": (2, 2)},
    "zip_code": {"names": ("zip", "zipcode", "zip_code", "postal_code"), "words": ("zip", "postal"), "regex": r"\d{5}(-?\d{4})?$"},
    "email": {"names": ("email", "email_address", "e_mail"), "words": ("email",), "regex": r"[^@\s]+@[^@\s]+\.[^@\s]+$"},
    "phone_number": {"names": ("phone", "phone_number", "telephone", "fax"), "words": ("phone", "fax"), "regex": r"\+?[\d\s().-]{7,20}$"},
    "npi": {"names": ("npi", "provider_npi"), "words": ("npi", "national provider"), "regex": r"\d{10}$", "length": (10, 10)},
    "loinc_code": {"names": ("loinc", "loinc_code"), "words": ("loinc",), "regex": r"\d{1,5}-\d$"},
    "ndc_code": {"names": ("ndc", "ndc_code"), "words": ("ndc", "drug code"), "regex": r"\d{4,5}-?\d{3,4}-?\d{1,2}$"},
    "drg_code": {"names": ("drg", "drg_code"), "words": ("drg",), "regex": r"\d{3}$"},
    "revenue_code": {"names": ("revenue_code", "rev_code"), "words": ("revenue code",), "regex": r"\d{3,4}$"},
    "bill_type_code": {"names": ("bill_type", "type_of_bill"), "words": ("bill type",), "regex": r"\d{3,4}$"},
    "place_of_service": {"names": ("place_of_service", "pos"), "words": ("place of service",), "regex": r"\d{2}$"},
    "modifier_code": {"names": ("modifier", "modifier_code"), "words": ("modifier",), "regex": r"[A-Z0-9]{2}$"},
    "tax_id": {"names": ("tax_id", "tin", "ein"), "words": ("tax id",), "regex": r"\d{2}-?\d{7}$"},
    "member_id": {"names": ("member_id", "mbr_id", "subscriber_id"), "words": ("member",), "regex": r"[A-Za-z0-9_-]{3,}$"},
    "claim_number": {"names": ("claim_number", "claim_id", "clm_num"), "words": ("claim",), "regex": r"[A-Za-z0-9-]{4,}$"},
    "claim_status": {"names": ("claim_status", "status"), "words": ("status",)},
    "gender": {"names": ("gender", "sex"), "words": ("gender", "sex"), "values": ("M", "F", "U", "X")},
    "yes_no_flag": {"names": ("flag", "yn", "indicator"), "words": ("yes/no", "flag"), "values": ("Y", "N")},
    "boolean_flag": {"names": ("is_active", "is_deleted", "active"), "words": ("boolean",), "values": ("true", "false", "0", "1")},
    "birth_date": {"names": ("birth_date", "dob", "date_of_birth"), "words": ("birth",)},
    "service_date": {"names": ("service_date", "dos", "date_of_service"), "words": ("service date",)},
    "timestamp": {"names": ("timestamp", "ts", "created_at", "updated_at", "loaded_at"), "words": ("timestamp", "time of")},
    "calendar_year": {"names": ("year", "calendar_year"), "words": ("year",), "regex": r"(19|20)\d{2}$", "range": (1900, 2099)},
    "city": {"names": ("city", "town"), "words": ("city",), "regex": r"[^\d]{2,}$"},
    "us_county": {"names": ("county", "county_name"), "words": ("county",)},
    "person_first_name": {"names": ("first_name", "fname", "given_name"), "words": ("first name", "given name")},
    "person_last_name": {"names": ("last_name", "lname", "surname", "family_name"), "words": ("last name", "surname")},
    "visit_count": {"names": ("visit_count", "visits"), "words": ("visits",), "range": (0, None)},
    "url": {"names": ("url", "uri", "link", "website"), "words": ("url", "web address"), "regex": r"https?://\S+$"},
    "address_line_1": {"names": ("address", "address_1", "address_line_1", "street", "street_address"), "words": ("address", "street")},
    "amisys_member_id": {"names": ("amisys_id", "amisys_member_id", "client_member_id", "clientmemberid"), "words": ("amisys", "client member"), "regex": r"[A-Z]{2}\d{11}$", "length": (13, 13)},
    "lob": {"names": ("lob", "line_of_business", "pbp_type", "pbptype", "plan_type", "coverage_type"), "words": ("line of business", "plan type", "coverage type"), "values": ("MEDICAID", "MEDICARE", "MARKETPLACE", "DUALS", "MD", "ME", "MP")},
    "load_mode": {"names": ("load_mode", "file_mode", "source_load_mode"), "words": ("load mode", "file mode"), "values": ("I", "R", "A", "U")},
    "plan_description": {"names": ("plan_description", "plan_desc", "plandesc", "plan_name"), "words": ("plan description",), "regex": r"[A-Z_]+_(MEDICAID|MEDICARE|MARKETPLACE|DUALS)$"},
    "population_type": {"names": ("population", "population_type", "populationtype", "population_cd", "pop_type"), "words": ("population type", "population code"), "regex": r"([A-Z]{2}|[A-Za-z\s]+)$"},
    "project_code": {"names": ("project_code", "proj_code", "assignment"), "words": ("project code", "assignment"), "regex": r"[A-Z0-9].{0,49}$"},
    "project_number": {"names": ("project", "project_number", "proj_num", "project_id"), "words": ("project number", "project id"), "regex": r"\d+$"},
    "ranking_tier": {"names": ("rank", "tier", "risk_tier", "total_rank", "totalrank", "priority_tier"), "words": ("rank", "tier", "priority"), "values": ("1", "2", "3", "4", "5", "6", "99", "100", "115")},
    "reporting_population": {"names": ("reporting_population", "rptpop", "report_pop", "h_contract", "hcontract", "contract"), "words": ("reporting population", "h-contract"), "regex": r"(HMO|H\d{4})$"},
    "schedule_type": {"names": ("schedule_type", "scheduling_type"), "words": ("schedule type", "scheduling channel"), "values": ("TEL", "POR")},
    "service_type": {"names": ("service_type", "assessment_type"), "words": ("service type", "assessment type"), "values": ("IHA", "TEL", "AUD", "RET")},
    "vendor_identifier": {"names": ("vendor", "vendor_id", "vendor_name", "vendor_code", "outreach_vendor"), "words": ("vendor",), "regex": r"[A-Z][A-Z0-9]*(-[A-Z]+)*$"},
    "unmapped": {"names": (), "words": ()},
}
#: Abbreviations in names.
ABBREVIATIONS = {"mbr": "member", "clm": "claim", "num": "number", "nbr": "number", "cd": "code", "dt": "date", "addr": "address", "st": "state", "prov": "provider", "svc": "service", "dob": "birth_date", "amt": "amount", "desc": "description"}
#: Shares of the evidence, and the least share of values that must look right.
WEIGHTS, LEAST_SHARE = {"name": 0.6, "description": 0.2, "values": 0.2}, 0.7


def words_of(name: str) -> list[str]:
    return [ABBREVIATIONS.get(w, w) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w]


def by_name(name: str, domain: dict) -> float:
    own = "_".join(words_of(name))
    if name.lower() in domain["names"] or own in domain["names"]:
        return 1.0
    return 0.7 if any(f"_{n}_" in f"_{own}_" for n in domain["names"]) else 0.0


def value_shares(df: DataFrame, column: str):
    """For each domain with a form, the share of non-NULL values that have it, from one pass over all rows."""
    x = F.col(f"`{column}`").cast("string")
    shares = {n: F.avg(F.when(x.isNotNull(), (x.rlike(f"^(?:{d['regex']})") if d.get("regex") else x.isin(list(d["values"]))).cast("double"))) for n, d in DOMAINS.items() if d.get("regex") or d.get("values")}
    return df.agg(*(c.alias(n) for n, c in shares.items()))


def infer(df: DataFrame | None, column: str, description: str = "") -> tuple[str, float]:
    """The likeliest domain and its share of the evidence there is; ties by name."""
    shares = value_shares(df, column).first().asDict() if df is not None else {}
    best = ("unmapped", 0.0)
    for n, d in sorted(DOMAINS.items()):
        evidence = {"name": by_name(column, d)}
        if description:
            evidence["description"] = 1.0 if any(w in description.lower() for w in d["words"]) else 0.0
        if shares.get(n) is not None:
            evidence["values"] = shares[n] if shares[n] >= LEAST_SHARE else 0.0
        total = sum(WEIGHTS[k] * v for k, v in evidence.items()) / sum(WEIGHTS[k] for k in evidence)
        if total > best[1] and (evidence["name"] or evidence.get("description")):
            best = (n, round(total, 4))
    return best if best[1] >= 0.3 else ("unmapped", best[1])
