"""The superstep operator: vertex programs and the loop that runs them."""
