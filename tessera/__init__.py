"""Tessera: interval, automaton and reachability analytics on PySpark."""
