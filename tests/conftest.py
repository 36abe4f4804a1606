import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from joblode.schemas import RAW_FIELDS  # noqa: E402
from joblode.session import local_session  # noqa: E402

AS_OF = date(2026, 3, 22)

_RAW = ", ".join(f"{name} {'array<string>' if name == 'tags' else 'string'}" for name in RAW_FIELDS)
RAW_SCHEMA = f"{_RAW}, src_rank int, payload_id string, pos bigint"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def listings(spark):
    """Raw listings from dicts; order columns default to the place in the list."""

    def build(*rows):
        full = [
            {"tags": [], "src_rank": 0, "payload_id": "p", "pos": i, **row} for i, row in enumerate(rows)
        ]
        names = [*RAW_FIELDS, "src_rank", "payload_id", "pos"]
        return spark.createDataFrame([tuple(row.get(name) for name in names) for row in full], RAW_SCHEMA)

    return build
