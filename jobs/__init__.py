"""Jobs that users run: a function of a session and plain paths, a command line, a small configuration file."""
