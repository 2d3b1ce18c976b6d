import shutil
import tempfile

import pytest

from featurespark.streaming.apply import fit_for_stream, run_to_memory, transform_stream
from tests.conftest import SF001


def test_fitted_transforms_on_stream(spark):
    src = tempfile.mkdtemp(prefix="fs-stream-src-")
    shutil.copy(f"{SF001}/events.parquet", f"{src}/part-0.parquet")
    batch = spark.read.parquet(src)
    specs = [{"column_name": "value", "fe_method": "standardization"},
             {"column_name": "event_type", "fe_method": "label_encoding"},
             {"column_name": "event_type", "fe_method": "frequency_encoding"}]
    fitted = fit_for_stream(batch, specs)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    out = transform_stream(stream, fitted)
    run_to_memory(out, "fs_stream_out", tempfile.mkdtemp(prefix="fs-stream-ckpt-"))
    got = spark.sql("SELECT * FROM fs_stream_out")
    ref = fitted.transform(batch).df
    cols = ["event_id", "value_standardized", "event_type_encoded", "event_type_freq"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, ref.select(*cols).collect()))


def test_ntile_refused_on_stream(spark):
    src = tempfile.mkdtemp(prefix="fs-stream-src2-")
    shutil.copy(f"{SF001}/events.parquet", f"{src}/part-0.parquet")
    batch = spark.read.parquet(src)
    fitted = fit_for_stream(batch, [{"column_name": "value", "fe_method": "binning", "order_key": "event_id"}])
    with pytest.raises(ValueError):
        transform_stream(spark.readStream.schema(batch.schema).parquet(src), fitted)


def test_shared_dictionaries_on_stream(spark):
    src = tempfile.mkdtemp(prefix="fs-stream-src3-")
    shutil.copy(f"{SF001}/events.parquet", f"{src}/part-0.parquet")
    batch = spark.read.parquet(src)
    specs = [{"column_name": "event_type", "fe_method": "label_encoding"},
             {"column_name": "user_id", "fe_method": "label_encoding"},
             {"column_name": "event_type", "fe_method": "target_encoding", "target_column": "value"},
             {"column_name": "user_id", "fe_method": "target_encoding", "target_column": "value"}]
    fitted = fit_for_stream(batch, specs)
    out = transform_stream(spark.readStream.schema(batch.schema).parquet(src), fitted)
    run_to_memory(out, "fs_stream_out3", tempfile.mkdtemp(prefix="fs-stream-ckpt3-"))
    cols = ["event_id", "event_type_encoded", "user_id_encoded", "event_type_target_encoded", "user_id_target_encoded"]
    got = sorted(map(tuple, spark.sql("SELECT * FROM fs_stream_out3").select(*cols).collect()))
    ref = sorted(map(tuple, fitted.transform(batch).df.select(*cols).collect()))
    assert got == ref
