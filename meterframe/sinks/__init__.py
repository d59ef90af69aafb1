"""Outputs: the partitioned ``energies`` table, roll-up tables, the wide point table."""
