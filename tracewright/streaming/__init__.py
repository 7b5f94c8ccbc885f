"""Events and structured streaming."""
