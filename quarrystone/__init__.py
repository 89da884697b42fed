"""quarrystone: register analytics and corpus operators, expressed as Spark plans."""
