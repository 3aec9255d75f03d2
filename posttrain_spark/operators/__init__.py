"""DataFrame operators: labels, rewards, rollouts, chat, datasets and evaluation."""
