"""Every operator applied to the driver's tables, with SQL that gives the same rows."""
