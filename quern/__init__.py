"""quern: property graphs of evidence-backed facts on Spark DataFrames."""

from quern.operators.graph import POLICIES, Policy, Step, assign_tiers, compile_slice, token_estimate
from quern.operators.state import Store

__all__ = ["POLICIES", "Policy", "Step", "Store", "assign_tiers", "compile_slice", "token_estimate"]
