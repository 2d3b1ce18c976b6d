import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featurespark.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def customers(spark):
    """The reference's 8-row customers table (NULL age for id 4, NULL income for id 6)."""
    rows = [
        (1, "John Doe", 35, 75000.0, "Male", dt.date(2023, 1, 15), "Premium", 12),
        (2, "Jane Smith", 28, 52000.0, "Female", dt.date(2023, 3, 22), "Standard", 5),
        (3, "Bob Johnson", 45, 120000.0, "Male", dt.date(2022, 11, 10), "Premium", 25),
        (4, "Alice Brown", None, 48000.0, "Female", dt.date(2023, 6, 1), "Basic", 2),
        (5, "Charlie Wilson", 62, 95000.0, "Male", dt.date(2021, 8, 20), "Premium", 45),
        (6, "Diana Lee", 31, None, "Female", dt.date(2023, 9, 5), "Standard", 8),
        (7, "Edward Kim", 29, 68000.0, "Male", dt.date(2023, 2, 14), "Standard", 15),
        (8, "Fiona Garcia", 55, 250000.0, "Female", dt.date(2020, 4, 30), "Premium", 100),
    ]
    schema = ("customer_id bigint, name string, age int, income double, gender string, signup_date date, "
              "category string, purchase_count int")
    return spark.createDataFrame(rows, schema)
