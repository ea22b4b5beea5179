"""tallyframe: fidelity, validity, utility and privacy of mixed-type tables as DataFrame queries."""
