"""Table-to-table operators: a DataFrame in, a lazy DataFrame out unless a function says otherwise."""
