"""Runnable jobs: a function that takes a session, a small config file and a command line for each."""
