"""Code-health analytics on Spark: relational reports, import graphs, call sites,
patch evidence and scores as DataFrame functions."""
