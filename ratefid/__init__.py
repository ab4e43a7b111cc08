"""Rate-fidelity analysis of context selection as DataFrame operators."""
