"""The operators that have to be native run no Python on the executors."""

import re

from porespan.llm import fingerprints, quality_rules
from porespan.llm.common import table
from tests.test_plans import PYTHON, plan


def test_native_operators(spark, sf):
    docs = table(spark, sf, "documents")
    for df in (fingerprints.fingerprint_edits(docs), quality_rules.adaptive_rules(docs, carry=["doc_id"])):
        p = plan(df)
        assert not PYTHON.search(p) and not re.search("Cartesian|NestedLoop", p)
