"""Column expressions: hydrology, hydraulics and earthwork formulas."""
