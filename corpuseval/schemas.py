"""Table schemas shared by the readers, validators and tests."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOLEAN = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
)
STRING_MAP, COUNT_MAP, DOUBLE_MAP = (T.MapType(STRING, v) for v in (STRING, LONG, DOUBLE))


def struct(**fields: T.DataType) -> T.StructType:
    """A nullable struct type; unlike a DDL string it needs no running session."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ITEM = struct(source_path=STRING, relative_path=STRING, width=INT, height=INT, category=STRING)

BOX = struct(region=STRING, x1=INT, y1=INT, x2=INT, y2=INT, text=STRING, score=DOUBLE)

EVAL_ITEM = struct(
    item_id=STRING,
    dataset_id=STRING,
    source_path=STRING,
    input_path=STRING,
    relative_path=STRING,
    width=INT,
    height=INT,
    source_category=STRING,
    benchmark_category=STRING,
    prompt=STRING,
    prompt_path=STRING,
    seed_mask_path=STRING,
    seed_overlay_path=STRING,
    notes=STRING_MAP,
)

MASK_RESULT = struct(
    provider_name=STRING,
    mask_nonzero=LONG,
    confidence=DOUBLE,
    boxes=T.ArrayType(BOX),
    latency_ms=DOUBLE,
    meta=STRING_MAP,
)

RESTORE_RESULT = struct(provider_name=STRING, latency_ms=DOUBLE, peak_vram_mb=DOUBLE, meta=STRING_MAP)

EVAL_RESULT = struct(
    item=EVAL_ITEM,
    status=STRING,
    note=STRING,
    mask_provider=STRING,
    restore_provider=STRING,
    mask_path=STRING,
    overlay_path=STRING,
    restored_path=STRING,
    metrics=DOUBLE_MAP,
    manual_score=STRING,
    mask_result=MASK_RESULT,
    restore_result=RESTORE_RESULT,
)

REPORT = struct(
    run_id=STRING,
    dataset_id=STRING,
    mask_provider=STRING,
    restore_provider=STRING,
    item_count=LONG,
    status_counts=COUNT_MAP,
    results=T.ArrayType(EVAL_RESULT),
)

DETECTION = struct(category=STRING, mask_nonzero=LONG, confidence=DOUBLE, boxes=T.ArrayType(BOX))

BATCH_RESULT = struct(
    item=ITEM,
    status=STRING,
    note=STRING,
    mask_provider=STRING,
    restore_provider=STRING,
    mask_path=STRING,
    overlay_path=STRING,
    restored_path=STRING,
    detection=DETECTION,
    mask_meta=STRING_MAP,
    restore_meta=STRING_MAP,
    mask_latency_ms=DOUBLE,
    restore_latency_ms=DOUBLE,
)

RUN_SUMMARY = struct(
    run_version=INT,
    run_status=STRING,
    run_id=STRING,
    resume_count=LONG,
    image_count=LONG,
    completed_item_count=LONG,
    pending_item_count=LONG,
    category_counts=COUNT_MAP,
    status_counts=COUNT_MAP,
    results=T.ArrayType(BATCH_RESULT),
)

# Header fields that may appear in a scan manifest, a plan or a run manifest.
MANIFEST = struct(
    scan_version=INT,
    plan_version=INT,
    run_version=INT,
    scan_id=STRING,
    plan_id=STRING,
    run_id=STRING,
    input_root=STRING,
    recursive=BOOLEAN,
    scan_only=BOOLEAN,
    limit=LONG,
    mask_provider=STRING,
    restore_provider=STRING,
    item_count=LONG,
    category_counts=COUNT_MAP,
    items=T.ArrayType(ITEM),
)

ROI_SPEC = struct(
    category=STRING,
    region=STRING,
    x1=DOUBLE, y1=DOUBLE, x2=DOUBLE, y2=DOUBLE,
    fx1=DOUBLE, fy1=DOUBLE, fx2=DOUBLE, fy2=DOUBLE,
    cx1=DOUBLE, cy1=DOUBLE, cx2=DOUBLE, cy2=DOUBLE,
)
