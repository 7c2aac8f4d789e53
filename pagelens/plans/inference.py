"""Quality prediction over recogniser pages: features of the JSON groups, scores, and the pages with their predictions in them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.boosting import Model, score
from pagelens.plans.features import page_features
from pagelens.runtime import durable
from pagelens.sources import page_json

#: The feature groups that need nothing but a page's JSON.
JSON_GROUPS = ("segmentation", "regionization", "layout", "htr_confidence", "text")
MEMBER = "quality_prediction"


def predict(bodies: DataFrame, models: dict[str, Model], groups: Sequence[str] = JSON_GROUPS, edges: dict[str, Sequence[float]] | None = None, key: str = "page_no") -> DataFrame:
    """key and pred_<target> of every readable page; features that a model wants and pages lack are missing values.

    ``bodies`` has the key (repeated rows count once) and body. A model without features is a ValueError.
    """
    for target, model in models.items():
        if not model.features:
            raise ValueError(f"the model of {target} has no feature names")
    # Features are computed once, however many models read them.
    out = durable(page_features(page_json.pages(bodies, key), groups, edges, key), "features")
    for target, model in models.items():
        out = score(out, model, f"pred_{target}")
    return out.select(key, *(f"pred_{t}" for t in models))


def annotated(bodies: DataFrame, models: dict[str, Model], groups: Sequence[str] = JSON_GROUPS, edges: dict[str, Sequence[float]] | None = None, key: str = "page_no") -> DataFrame:
    """key, body and pred_<target>: each page with its predictions under annotations.quality_prediction.<target>.

    Other members stay as they are, earlier predictions of other targets too. Pages that cannot be read
    keep their body, with null predictions; repeated rows count once.
    """
    once = bodies.select(key, "body").dropDuplicates([key])
    names = [f"pred_{t}" for t in models]
    scored = durable(predict(once, models, groups, edges, key), "predictions")
    joined = once.alias("a").join(scored.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left").select(F.col(f"a.{key}").alias(key), "body", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(batch.column(2 + i).to_pylist() for i in range(len(names)))))
            texts = []
            for body, values in zip(batch.column(1).to_pylist(), found):
                if body is not None and any(v is not None for v in values):
                    page = json.loads(body)
                    notes = page["annotations"] if isinstance(page.get("annotations"), dict) else page.setdefault("annotations", {})
                    if not isinstance(notes, dict):
                        notes = page["annotations"] = {}
                    kept = notes.get(MEMBER) if isinstance(notes.get(MEMBER), dict) else {}
                    notes[MEMBER] = {**kept, **{t: v for t, v in zip(models, values) if v is not None}}
                    body = json.dumps(page, ensure_ascii=False)
                texts.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(batch.column(2 + i) for i in range(len(names)))], names=[key, "body", *names])

    kind = dict(bodies.dtypes)[key]
    return joined.mapInArrow(run, ", ".join([f"{key} {kind}", "body string", *(f"{n} double" for n in names)]))
