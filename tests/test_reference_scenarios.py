"""The reference's own scenarios (its script test and manual guide), run for real."""
import math
import tempfile

import pandas as pd
import pytest

from featurespark.operators.transforms import apply_transforms
from featurespark.sources import io as IO


def test_create_table_as_select(spark, customers):
    """CTAS of standardization(age), log(income), label(category) with the
    original columns kept, written as <table>_transformed."""
    specs = [{"column_name": "age", "fe_method": "standardization"},
             {"column_name": "income", "fe_method": "log_transformation"},
             {"column_name": "category", "fe_method": "label_encoding"}]
    res = apply_transforms(customers, specs, include_original=True)
    target = tempfile.mkdtemp(prefix="fs-ctas-") + "/customers_transformed"
    IO.write_table(res.df, target)
    back = spark.read.parquet(target)
    assert back.columns == customers.columns + ["age_standardized", "income_log", "category_encoded"]
    assert back.count() == 8
    IO.write_table(res.df.limit(3), target)          # create-or-replace
    assert spark.read.parquet(target).count() == 3


def test_employee_guide(spark):
    """The guide's Employee example: salary standardized and logged, age in 4
    tiles, department label-encoded, all next to the original columns."""
    rows = [(1, "Ann", 30, 50000.0, "Sales"), (2, "Bo", 41, 72000.0, "IT"), (3, "Cy", 25, 39000.0, "HR"),
            (4, "Di", 52, 98000.0, "IT"), (5, "Ed", 36, 61000.0, "Sales"), (6, "Fa", 29, 45000.0, "HR"),
            (7, "Gu", 47, 83000.0, "IT"), (8, "Ha", 33, 57000.0, "Sales")]
    emp = spark.createDataFrame(rows, "id long, name string, age int, salary double, department string")
    specs = [{"column_name": "salary", "fe_method": "standardization"},
             {"column_name": "salary", "fe_method": "log_transformation"},
             {"column_name": "age", "fe_method": "binning", "num_bins": 4, "order_key": "id"},
             {"column_name": "department", "fe_method": "label_encoding"}]
    out = {r["id"]: r for r in apply_transforms(emp, specs).df.collect()}
    sal = pd.Series([r[3] for r in rows])
    assert out[1]["salary_standardized"] == pytest.approx((50000 - sal.mean()) / sal.std())
    assert out[1]["salary_log"] == pytest.approx(math.log(50001))
    assert [out[i]["age_bin"] for i in (3, 6, 1, 8, 5, 2, 7, 4)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert {out[i]["department"]: out[i]["department_encoded"] for i in out} == {"HR": 0, "IT": 1, "Sales": 2}
