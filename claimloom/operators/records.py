"""Closed record shapes: DDL of each, and a check that a JSON text has exactly that shape.

A record has its fields and no others. NOT NULL marks fields that may not be null; whole numbers
are not booleans; a number stands for a double, whole or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lazy import arrow_function

EVIDENCE = (
    "struct<canonical_text_sha256:string not null,canonicaliser_version:string not null,content_id:string not null,end_line:int not null,end_offset:int not null,prefix:string not null,"
    "selected_text:string not null,source_json_sha256:string not null,source_url:string not null,start_line:int not null,start_offset:int not null,suffix:string not null>"
)
EXPRESSION = f"struct<evidence:array<{EVIDENCE}> not null,text:string not null>"
CONSTRAINT = "struct<lower_bound:string,lower_inclusive:boolean not null,upper_bound:string,upper_inclusive:boolean not null>"
RESOLUTION = f"struct<kind:string not null,constraint:{CONSTRAINT},expression:{EXPRESSION} not null,methodology:string not null,rationale:string not null>"
TIMES = f"struct<applicability:{RESOLUTION},event:{RESOLUTION},processing:{RESOLUTION},publication:{RESOLUTION}>"
CANDIDATE = f"struct<assertion:string not null,confidence:double not null,evidence:array<{EVIDENCE}> not null,rationale:string not null,times:{TIMES}>"
ASSERTION = "struct<object:string not null,object_kind:string not null,predicate:string not null,subject:string not null>"
DECISION_OUTPUT = f"struct<acceptance:string not null,conflict:string not null,disposition:string not null,mapping:string not null,scope:string not null,semantic_assertions:array<{ASSERTION}> not null,validation:string not null>"
MAPPING = f"struct<acceptance:string not null,candidate:{CANDIDATE} not null,claim_id:string not null,conflict:string,disposition:string not null,mapping:string not null,scope:string not null,semantic_assertions:array<{ASSERTION}> not null,validation:string not null>"
EXTRACTION = f"struct<candidate_claims:array<{CANDIDATE}> not null,mentions:array<{EXPRESSION}> not null,temporal_expressions:array<{EXPRESSION}> not null>"
ENTITY = "struct<entity_id:string not null,label:string not null>"
REFERENCE = "struct<identity:string not null,kind:string not null,schema_version:string not null>"
PROVENANCE = f"struct<evidence:array<{EVIDENCE}> not null,methodology:string not null,rationale:string not null,reasoning_invocation:{REFERENCE}>"
OUTCOME = f"struct<kind:string not null,entity_id:string,entity:{ENTITY},confidence:double not null,provenance:{PROVENANCE} not null>"
ASSESSMENT = f"struct<artefact:{REFERENCE} not null,rationale:string not null,suitable:boolean not null,term:string not null>"
CHANGE = "struct<description:string not null,external_terms:array<string> not null,kind:string not null,term:string not null>"
_MAPPED = f"struct<acceptance:string not null,conflict:string not null,disposition:string not null,mapping:string not null,scope:string not null,semantic_assertions:array<{ASSERTION}> not null,validation:string not null>"
#: Outputs of the four roles of a review, in their order.
ROLES = {
    "researcher": "struct<query:string not null,rationale:string not null>",
    "proposer": "struct<assessments:array<struct<artefact_index:int not null,rationale:string not null,suitable:boolean not null,term:string not null>> not null,conclusion:string not null,rationale:string not null>",
    "critic": "struct<rationale:string not null>",
    "synthesiser": f"struct<changes:array<{CHANGE}> not null,mapping:{_MAPPED} not null,ontology_turtle:string not null,rationale:string not null,reconsideration_reason:string not null,shacl_turtle:string not null>",
}


def _fault(value, kind: T.DataType, path: str, optional: frozenset) -> str | None:
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return path or "record"
        fields = {f.name: f for f in kind.fields}
        if extra := sorted(set(value) - set(fields)):
            return f"{path}.{extra[0]}".lstrip(".")
        for name, field in fields.items():
            here = f"{path}.{name}".lstrip(".")
            if name not in value:
                if name not in optional:
                    return here
            elif value[name] is None:
                if not field.nullable:
                    return here
            elif fault := _fault(value[name], field.dataType, here, optional):
                return fault
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return path
        return next((f for i, x in enumerate(value) if (f := _fault(x, kind.elementType, f"{path}[{i}]", optional))), None)
    if isinstance(kind, T.BooleanType):
        ok = isinstance(value, bool)
    elif isinstance(kind, T.IntegerType):
        ok = isinstance(value, int) and not isinstance(value, bool)
    elif isinstance(kind, T.DoubleType):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool)
    else:
        ok = isinstance(value, str)
    return None if ok else path


def shape_error(ddl: str, *optional: str) -> Callable[[Column], Column]:
    """A function of a JSON column: the path of its first field that is missing, foreign or of another type; "json" for what is not JSON; null if all is well."""
    may_lack = frozenset(optional)

    def check(text):
        import json

        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return "json"
        return _fault(value, shape, "", may_lack)

    def apply(text: Column) -> Column:
        nonlocal shape
        shape = shape or T.StructType.fromDDL(f"r {ddl}")["r"].dataType
        return arrow_function("string")(check)(text)

    shape: T.StructType | None = None
    return apply


def parsed(text: Column, ddl: str) -> Column:
    return F.from_json(text, T.StructType.fromDDL(f"r {ddl}")["r"].dataType)
