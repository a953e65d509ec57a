"""Jobs that continue as Structured Streaming queries.

Each works on any streaming DataFrame; state, offsets and results live under
the folder the caller names, so a restart goes on where it stopped.
"""
