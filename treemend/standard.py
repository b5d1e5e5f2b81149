"""Ready-made well-data definitions: record types, tree, references, rules.

Everything here is a fixed value that has to match the well-data model the
records come from.
"""

from __future__ import annotations

import json

from treemend.model import AccessDef, CurveArrays, ReferenceDef, Rule, Taxonomy, TypeNode

_STAMPS = {"ROW_CREATED_DATE": "date", "ROW_CREATED_BY": "string", "ROW_CHANGED_DATE": "date", "ROW_CHANGED_BY": "string"}
_CHANGED = {"ROW_CHANGED_DATE": "date", "ROW_CHANGED_BY": "string"}


def _types(strings: str = "", numbers: str = "", dates: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for kind, names in (("string", strings), ("number", numbers), ("date", dates)):
        out.update({n: kind for n in names.split()})
    return out


ACCESS: dict[str, AccessDef] = {
    "WellBore": AccessDef(
        "WellBore", "WELL", ("UWI",),
        {
            **_types("UWI WELL_NAME LEASE_NAME DEPTH_DATUM OPERATOR ASSIGNED_FIELD CURRENT_STATUS REMARK",
                     "FINAL_TD SURFACE_LATITUDE SURFACE_LONGITUDE DEPTH_DATUM_ELEV GROUND_ELEV",
                     "COMPLETION_DATE SPUD_DATE"),
            **_STAMPS,
        },
    ),
    "MarkerPick": AccessDef(
        "MarkerPick", "STRAT_WELL_SECTION", ("STRAT_NAME_SET_ID", "STRAT_UNIT_ID", "UWI", "INTERP_ID"),
        {**_types("STRAT_NAME_SET_ID STRAT_UNIT_ID UWI INTERP_ID DOMINANT_LITHOLOGY REMARK", "PICK_DEPTH"), **_STAMPS},
        constants={"STRAT_NAME_SET_ID": "UNKNOWN", "INTERP_ID": "UNKNOWN", "DOMINANT_LITHOLOGY": "UNKNOWN"},
    ),
    "MarkerWell": AccessDef(
        "MarkerWell", "STRAT_WELL_SECTION", ("STRAT_NAME_SET_ID", "STRAT_UNIT_ID", "UWI"),
        {**_types("STRAT_NAME_SET_ID STRAT_UNIT_ID UWI INTERP_ID DOMINANT_LITHOLOGY REMARK", "PICK_DEPTH"), **_CHANGED},
    ),
    "WellTop": AccessDef(
        "WellTop", "STRAT_UNIT", ("STRAT_NAME_SET_ID", "STRAT_UNIT_ID"),
        {**_types("STRAT_NAME_SET_ID STRAT_UNIT_ID LONG_NAME ORDINAL_AGE_CODE REMARK"), **_CHANGED},
    ),
    "Log": AccessDef(
        "Log", "WELL_LOG_CURVE", ("UWI", "CURVE_ID"),
        {**_types("UWI CURVE_ID REPORTED_DESC SOURCE", "NULL_REPRESENTATION VALUE_COUNT MAX_INDEX MIN_INDEX"), **_STAMPS},
    ),
    "LogCurve": AccessDef(
        "LogCurve", "WELL_LOG_CURVE_VALUE", ("UWI", "CURVE_ID", "SAMPLE_ID"),
        {**_types("UWI CURVE_ID", "SAMPLE_ID INDEX_VALUE MEASURED_VALUE"), **_STAMPS},
    ),
    "Production": AccessDef(
        "Production", "PDEN", ("PDEN_SUBTYPE", "PDEN_ID", "SOURCE"),
        {**_types("PDEN_SUBTYPE PDEN_ID SOURCE"), **_STAMPS},
    ),
}

WELL_TREE = Taxonomy(
    (
        TypeNode(
            "WellBore", "UWI", "SURFACE_LATITUDE", "SURFACE_LONGITUDE",
            children=(
                TypeNode("Log", "CURVE_ID", parent_key="UWI = [UWI]", arrays=CurveArrays("WELL_LOG_CURVE_VALUE", ("UWI", "CURVE_ID"))),
                TypeNode("MarkerPick", "STRAT_UNIT_ID", parent_key="UWI = [UWI]", use_parent_location=True),
            ),
        ),
    )
)

REFERENCES = (
    ReferenceDef("WellBore", "FIELD", "FIELD_ID", "FIELD_NAME", "ASSIGNED_FIELD"),
    ReferenceDef("WellBore", "BUSINESS_ASSOCIATE", "BUSINESS_ASSOCIATE_ID", "BA_LONG_NAME", "OPERATOR"),
    ReferenceDef("WellBore", "R_WELL_STATUS", "STATUS", "LONG_NAME", "CURRENT_STATUS", "STATUS_TYPE=STATUS", insert=False),
    ReferenceDef("WellBore", "R_WELL_DATUM_TYPE", "WELL_DATUM_TYPE", "LONG_NAME", "DEPTH_DATUM"),
    ReferenceDef("MarkerPick", "STRAT_NAME_SET", "STRAT_NAME_SET_ID", "STRAT_NAME_SET_NAME", "STRAT_NAME_SET_ID"),
    ReferenceDef("MarkerPick", "WELL", "UWI", "UWI", "UWI"),
    ReferenceDef("MarkerPick", "STRAT_UNIT", "STRAT_UNIT_ID", "LONG_NAME", "STRAT_UNIT_ID", "STRAT_NAME_SET_ID=UNKNOWN"),
)

CSV_MAPPINGS = {
    "WellBore": "UWI=2; FINAL_TD=22; WELL_NAME=4; SURFACE_LATITUDE=6; SURFACE_LONGITUDE=7; LEASE_NAME=3; DEPTH_DATUM_ELEV=20; "
    "DEPTH_DATUM=21; OPERATOR=18; ASSIGNED_FIELD=5; CURRENT_STATUS=37; SPUD_DATE=28; COMPLETION_DATE=29",
    "MarkerPick": "UWI=2; STRAT_UNIT_ID=7; PICK_DEPTH=8",
    "Production": "PDEN_ID=3",
}


def _missing(formation: str) -> str:
    keys = {"UWI": "!UWI", "STRAT_UNIT_ID": formation, "STRAT_NAME_SET_ID": "UNKNOWN", "INTERP_ID": "UNKNOWN"}
    return json.dumps({
        "DataType": "MarkerPick", "Keys": [{"Key": k, "Value": v} for k, v in keys.items()],
        "Defaults": [{"Default": "DOMINANT_LITHOLOGY", "Value": "UNKNOWN"}],
    })


def _complete(i: int, key: str, kind: str, attribute: str) -> Rule:
    return Rule(key, kind, "Completeness", "Completeness", attribute, rule_id=i)


def _predict(i: int, key: str, kind: str, function: str, fail: str, order: int, attribute: str = "", params: str = "") -> Rule:
    return Rule(key, kind, function, "Predictions", attribute, params, fail_rule=fail, order=order, rule_id=i)


def rules(formation: str) -> list[Rule]:
    """The quality and prediction rules; every well should have a pick of ``formation``."""
    return [
        _complete(1, "C1", "WellBore", "DEPTH_DATUM_ELEV"),
        _complete(2, "C2", "WellBore", "SURFACE_LATITUDE"),
        _complete(3, "C3", "WellBore", "SURFACE_LONGITUDE"),
        _predict(4, "P1", "WellBore", "DeleteDataObject", "C2", 1),
        _predict(5, "P2", "WellBore", "DeleteDataObject", "C3", 2),
        _predict(6, "P3", "WellBore", "PredictDepthUsingIDW", "C1", 10, "DEPTH_DATUM_ELEV"),
        Rule("V1", "WellBore", "ValidityRange", "Validity", "DEPTH_DATUM_ELEV", "{MinRange:0, MaxRange:5000}", rule_id=7),
        _predict(8, "P4", "WellBore", "PredictDepthUsingIDW", "V1", 12, "DEPTH_DATUM_ELEV"),
        _complete(9, "C4", "MarkerPick", "PICK_DEPTH"),
        _predict(10, "P5", "MarkerPick", "DeleteDataObject", "C4", 6),
        _complete(11, "C5", "WellBore", "GROUND_ELEV"),
        _predict(12, "P6", "MarkerPick", "PredictDepthUsingIDW", "C4", 5, "PICK_DEPTH"),
        _complete(13, "C6", "Log", "MIN_INDEX"),
        _complete(14, "C7", "Log", "MAX_INDEX"),
        _predict(15, "P7", "Log", "PredictLogDepthAttributes", "C7", 16, "MAX_INDEX"),
        _predict(16, "P8", "Log", "PredictLogDepthAttributes", "C6", 14, "MIN_INDEX"),
        Rule("E1", "WellBore", "Entirety", "Entirety", "INDEXID", json.dumps({"DataType": "MarkerPick", "Name": formation}), rule_id=17),
        _predict(18, "P9", "WellBore", "PredictMissingDataObjects", "E1", 4, "INDEXID", _missing(formation)),
    ]
