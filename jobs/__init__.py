"""Jobs that can be run from the command line, and their registered queries."""
