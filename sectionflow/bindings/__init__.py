"""The given tables read as section stacks, with one query per operator."""
