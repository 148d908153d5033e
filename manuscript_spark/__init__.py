"""Review of large collections of manuscripts as set-oriented DataFrame queries."""
